"""Words with their places: phrases matched by a join of positions, and the part of a text that says most of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.operators.search import PAIRS, idf, quantised, term_weight
from evidra.sources.tables import written

#: Characters of a fragment, at most.
FRAGMENT = 400
_WORD = r"[\p{L}\p{N}]"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; a word's place is its index."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def quoted(text: Column) -> Column:
    """What stands between double quotes, without parts that hold no word."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('"([^"]*)"'), 1), lambda p: p.rlike(_WORD))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, '"[^"]*"', " ")


def positions(records: DataFrame, key: str, fields: list[str], stem: bool = False) -> DataFrame:
    """(key, field, length, term, position) of each word of records' fields; length is the field's number of words."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("ws")) for f in fields])
    rows = records.select(key, F.explode(parts).alias("p")).select(key, "p.field", F.size("p.ws").alias("length"), F.posexplode("p.ws").alias("position", "term"))
    if not stem:
        return rows.select(key, "field", "length", "term", "position")
    from evidra.functions.stem import stemmed

    return rows.join(stemmed(rows), "term").select(key, "field", "length", F.col("stem").alias("term"), "position")


def phrase_terms(asked: DataFrame, stem: bool = False) -> DataFrame:
    """(q, phrase, n, place, term): the words of each of asked(q, phrases), phrase being its number and n its words."""
    rows = asked.select("q", F.posexplode("phrases").alias("phrase", "text")).select("q", "phrase", words(F.col("text")).alias("ws"))
    rows = rows.select("q", "phrase", F.size("ws").alias("n"), F.posexplode("ws").alias("place", "term"))
    if not stem:
        return rows
    from evidra.functions.stem import stemmed

    return rows.join(stemmed(rows), "term").select("q", "phrase", "n", "place", F.col("stem").alias("term"))


def phrase_matches(where: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """(q, phrase, key, field, length, tf): how often each of phrases stands in each field, its words in turn.

    A phrase may begin only where its rarest word says so; the other words are looked up at those places alone, so that a
    frequent word of many phrases costs no more than its occurrences."""
    often = where.groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    rarest = F.min_by(F.struct("term", "place"), F.struct(F.coalesce("often", F.lit(0)), F.col("place"))).alias("r")
    anchors = written(phrases.join(often, "term", "left").groupBy("q", "phrase", "n").agg(rarest).select("q", "phrase", "n", "r.*"))
    starts = where.join(anchors, "term").where("position >= place").select("q", "phrase", "n", key, "field", "length", (F.col("position") - F.col("place")).alias("start"))
    starts = written(starts)
    needed = starts.join(phrases.select("q", "phrase", "place", "term"), ["q", "phrase"]).withColumn("position", F.col("start") + F.col("place"))
    there = where.join(starts.select(key), key, "left_semi").select(key, "field", "position", "term")
    whole = needed.join(there, [key, "field", "position", "term"]).groupBy("q", "phrase", "n", key, "field", "length", "start").agg(F.count(F.lit(1)).alias("here")).where("here = n")
    return whole.groupBy("q", "phrase", key, "field", "length").agg(F.count(F.lit(1)).alias("tf"))


def phrase_scores(where: DataFrame, figures: DataFrame, key: str, phrases: DataFrame, boosts: dict[str, float], exact_lengths: bool = False) -> DataFrame:
    """(q, key, score): BM25 of phrases, whose weight is that of their words together; figures(field, n, mean_length)."""
    asked = written(where.join(phrases.select("term").distinct(), "term", "left_semi"))
    parts = max(int(where.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked.count() // PAIRS + 1)  # a task makes so many rows distinct
    df = asked.select("field", "term", key).repartition(parts, key).distinct().groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = phrases.select("q", "phrase", "place", "term").join(df, "term").join(F.broadcast(figures), "field")  # a row a field
    weights = weights.groupBy("q", "phrase", "field", "mean_length").agg(F.sum(idf(F.col("n"), F.col("df"))).alias("weight"))
    boost = F.lit(1.0)
    for f, b in boosts.items():
        boost = F.when(F.col("field") == f, b).otherwise(boost)
    length = F.col("length") if exact_lengths else quantised(F.col("length"))
    met = phrase_matches(asked, key, phrases).join(weights, ["q", "phrase", "field"])
    return met.groupBy("q", key).agg(F.sum(boost * F.col("weight") * term_weight(F.col("tf"), length, F.col("mean_length"))).alias("score"))


def best_fragments(hits: DataFrame, records: DataFrame, key: str, text: str, weights: DataFrame, most: int = FRAGMENT) -> DataFrame:
    """(q, key, fragment) for hits(q, key): of the parts of a text that begin with an asked word and have at most `most`
    characters, the one whose words weigh most by weights(q, term, w), each occurrence counting; of equal ones the first. It
    ends with a word; a text without asked words gives its beginning. Only the hits' texts are taken apart."""
    body = records.select(key, F.coalesce(text, F.lit("")).alias("text")).join(hits.select(key).distinct(), key, "left_semi")
    runs = body.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(rf"({_WORD}+|[^\p{{L}}\p{{N}}]+)"), 1)).alias("nth", "run"))
    before = W.partitionBy(key).orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    placed = runs.withColumn("start", F.coalesce(F.sum(F.length("run")).over(before), F.lit(0))).where(F.col("run").rlike(_WORD))
    placed = placed.select(key, F.lower("run").alias("term"), "start", (F.col("start") + F.length("run")).alias("end"))
    met = placed.join(hits.select("q", key), key).join(weights, ["q", "term"])
    within = W.partitionBy("q", key).orderBy("start").rangeBetween(0, most - 1)
    near = met.withColumn("near", F.collect_list(F.struct("end", "w")).over(within))  # words of one part, at most
    total = F.aggregate(F.filter("near", lambda x: x["end"] <= F.col("start") + most), F.lit(0.0), lambda a, x: a + x["w"])
    begin = near.where(F.col("end") <= F.col("start") + most).withColumn("total", F.round(total, 9)).groupBy("q", key).agg(F.min_by("start", F.struct(-F.col("total"), F.col("start"))).alias("start"))
    rows = hits.select("q", key).join(begin, ["q", key], "left").join(body, key).withColumn("start", F.coalesce("start", F.lit(0)))
    part = F.substr("text", F.col("start") + 1, F.lit(most))
    cut = (F.length("text") > F.col("start") + most) & F.substr("text", F.col("start") + most + 1, F.lit(1)).rlike(_WORD) & F.substr(part, F.lit(most), F.lit(1)).rlike(_WORD)
    whole = F.when(cut & part.rlike(rf"(?s)^.*[^\p{{L}}\p{{N}}]{_WORD}+$"), F.regexp_replace(part, rf"{_WORD}+$", "")).otherwise(part)
    return rows.select("q", key, F.regexp_replace(whole, r"[^\p{L}\p{N}]+$", "").alias("fragment"))
