"""Words with their places."""

from pyspark.sql import functions as F

from evidra.jobs import registry
from evidra.operators import phrases
from tests.conftest import DATA


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def asked(spark, *questions):
    df = spark.createDataFrame(list(enumerate(questions)), "q int, text string")
    return phrases.phrase_terms(df.select("q", phrases.quoted(F.col("text")).alias("phrases")))


def matches(spark, texts, *questions):
    found = phrases.phrase_matches(phrases.positions(docs(spark, *texts), "id", ["text"]), "id", asked(spark, *questions))
    return sorted((r["q"], r["phrase"], r["id"], r["tf"]) for r in found.collect())


def test_a_phrase_is_words_in_turn(spark):
    texts = ["the account list, THE account", "account the list", "the-account", "the big account", None, ""]
    assert matches(spark, texts, 'show "the Account" now') == [(0, 0, 0, 2), (0, 0, 2, 1)]
    assert matches(spark, texts, '"the account list" "list"', "no quotes", '"" "-"') == [(0, 0, 0, 1), (0, 1, 0, 1), (0, 1, 1, 1)]


def test_words_that_repeat_within_a_phrase(spark):
    assert matches(spark, ["a b a b a", "a b", "b a a b"], '"a b a"', '"a a"') == [(0, 0, 0, 2), (1, 0, 2, 1)]


def test_quotes_are_parts(spark):
    row = docs(spark, 'x "one two" y "three').select(phrases.quoted(F.col("text")).alias("q"), phrases.unquoted(F.col("text")).alias("u")).first()
    assert row["q"] == ["one two"] and row["u"].split() == ["x", "y", '"three']


def test_scores_follow_phrase_frequency_and_rarity(spark):
    d = docs(spark, "red car red car", "red car and more words of no use at all", "blue car", "red", "other")
    where = phrases.positions(d, "id", ["text"])
    figures = d.agg(F.lit("text").alias("field"), F.count(F.lit(1)).alias("n"), F.avg(F.size(phrases.words(F.col("text")))).alias("mean_length"))
    got = {(r["q"], r["id"]): r["score"] for r in phrases.phrase_scores(where, figures, "id", asked(spark, '"red car"', '"blue car"'), {"text": 2.0}).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 2)} and got[0, 0] > got[0, 1] > 0


def fragments(spark, text, weights, most=20):
    w = spark.createDataFrame([(0, t, x) for t, x in weights.items()], "q int, term string, w double")
    hits = spark.createDataFrame([(0, 0)], "q int, id long")
    return phrases.best_fragments(hits, docs(spark, text), "id", "text", w, most).first()["fragment"]


def test_best_fragment(spark):
    assert fragments(spark, "nothing here but then rare words and rare ones", {"rare": 1.0, "nothing": 0.5}) == "rare words and rare"
    assert fragments(spark, "one two. three four five", {"one": 1.0, "three": 1.0}) == "one two. three four"
    assert fragments(spark, "one x one", {"one": 1.0}, 4) == "one"
    assert fragments(spark, "no asked word in this text", {"zzz": 1.0}) == "no asked word in"
    assert fragments(spark, "", {"a": 1.0}) == "" and fragments(spark, "x" * 50, {"y": 1.0}) == "x" * 20
    assert fragments(spark, "élan \U0001f600 élan vital", {"vital": 2.0, "élan": 1.0}, 12) == "élan vital"


def test_texts_are_taken_apart_once_for_hits_and_weights(spark, monkeypatch):
    calls, keep = [], registry.T.search_tokens
    monkeypatch.setattr(registry.T, "search_tokens", lambda c: calls.append(1) or keep(c))
    registry.best_fragments_of_hits(spark, f"{DATA}/sf0.001")
    assert len(calls) == 1
