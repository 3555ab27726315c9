"""The pipeline, stage by stage against plain versions, on a table whose columns clash with names that operators use."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidra.llm import mixing, nearduplicates, packing, pii, quality, urls
from tests.conftest import DATA
from tests.llm.helpers import documents, odd_documents, rows_by_id
from tests.llm.test_operators import _plain_groups

def clashing(df):
    more = {"kept": False, "n_words": -1, "base_failed": "x", "quality_score": 0.5, "a,b": 2, "component_id": 7, "same": "s", "length": 1, "copies": 1}
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = clashing(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage gets and gives."""
    made, pii.MADE_WINDOWS = pii.MADE_WINDOWS, 200
    try:
        out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            out.append((docs, docs := corpus_pipeline.written(stage(spark, docs, folder))))
        return out
    finally:
        pii.MADE_WINDOWS = made


def test_stages_keep_the_columns(stages, folder, spark):
    names = spark.read.parquet(f"{folder}/documents.parquet").columns
    assert all(after.columns == names for _, after in stages[:-1]) and all(after.count() > 0 for _, after in stages)


def test_quality_stage(stages, spark, folder):
    before, after = stages[0]
    model = quality.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r.doc_id for r in before.collect() if quality._judged([r.text], model)[3][0]}
    assert {r.doc_id for r in after.collect()} == want and len(want) < before.count()


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    found = _plain_groups({r.doc_id: r.text for r in before.collect()}, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in found.items() if c == i)


def test_personal_data_stage(stages):
    before, after = (rows_by_id(x) for x in stages[2])
    assert before.keys() == after.keys()
    for i, r in before.items():
        text = after[i].text
        base = pii.base_spans(r.text)
        assert not pii.base_spans(text) and all(r.text[s:e] not in text or r.text.count(r.text[s:e]) > 1 for _, s, e in base)
        assert text == r.text if not base and "<" not in text else text.count("<") >= 1


def test_mixing_stage(stages):
    before, after = stages[3]
    want = {r.doc_id: round(r.taken / r["size"]) for r in mixing.plan(before).collect() if r["size"]}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in want.items() if n})


def test_packing_stage(stages):
    before, after = stages[4]
    got, want = (Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in x.collect()) for x in (after, packing.pieces(before)))
    assert got == want
    filled = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= packing.LENGTH for r in filled)


def test_quality_takes_clashing_and_odd_tables(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    docs = clashing(odd_documents(spark).drop("same"))
    model = quality.fit(docs, labels)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and quality.score(docs, model).count() == docs.count()
    assert quality.keep_good(documents(spark, []), model).collect() == []
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in quality.score(docs, model).where("kept").collect())


def test_ids_with_several_texts_keep_their_links(spark):
    """Rows of one id with different sets are one document: what either is linked with is in its group."""
    words = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(1, words("a")), (2, words("a") + " q"), (2, words("b")), (3, words("b") + " r"), (4, words("c")), (4, words("c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in nearduplicates.groups(docs).collect()) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_hot_tier_grows_in_proportion(spark, monkeypatch):
    """One group of near copies in many parts beside few others: part pairs of that group alone are never met, so what is
    compared grows with the number of copies, not with its square."""
    monkeypatch.setattr(nearduplicates, "BLOCK", 8)
    seen = []
    true_written = nearduplicates.written

    def counting(df):
        out = true_written(df)
        if df.columns == ["x", "y"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(nearduplicates, "written", counting)
    base = [f"w{i}" for i in range(200)]
    for n in (60, 240):
        texts = [" ".join([*base, f"own{k}"]) for k in range(n)] + [" ".join([*base[:100], *(f"z{k}_{i}" for i in range(100))]) for k in range(5)]
        got = rows_by_id(nearduplicates.groups(documents(spark, texts)))
        assert all(got[k].component_id == 0 for k in range(n)) and all(got[n + k].component_id == n + k for k in range(5))
    assert seen[1] <= 8 * max(seen[0], 4), seen


def test_url_rules_take_odd_tables(spark):
    """Null, empty and hostless urls, repeated rows, an empty table, and columns that clash."""
    kinds = "page_id long, url string, html string, host string, path string, node string, rule string, component long, verdict int"
    more = ("x", "y", "z", "r", 5, 9)
    rows = [(1, None, None), (2, "", "<p>"), (3, "nothing", None), (4, "http://a.net/x", None), (4, "http://a.net/x", None), (None, "https://b.org/fr/1", ""), (5, "://", "x"), (6, "http://A.EXAMPLE.com/de/" + "q" * 50_000, None)]
    got = urls.judge(spark.createDataFrame([(*r, *more) for r in rows], kinds)).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in got if r.rule) == [(0, "org/fr/", "allow"), (4, "net/", "block"), (4, "net/", "block"), (6, "example.com/de/", "block")]
    assert len(got) == len(rows) and all(r.verdict == "allow" and r.host == "" for r in got if r.page_id in (1, 2, 3, 5))
    assert urls.judge(spark.createDataFrame([], kinds)).collect() == []


def test_far_intervals_never_meet(spark, monkeypatch):
    """Vectors about ten directions, all of one label: pairs of intervals grow with the number of vectors, as those of different
    directions are dropped before vectors move; results are as by brute force."""
    import numpy as np

    from evidra.llm import embeddings
    from tests.llm.test_operators import _plain_vectors

    monkeypatch.setattr(embeddings, "PART", 8)
    seen, true_written = [], embeddings.written

    def counting(df):
        out = true_written(df)
        if df.columns == ["x", "y"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(embeddings, "written", counting)
    rng = np.random.default_rng(8)
    rows = [(i, (np.eye(10)[i % 10] + rng.normal(0, 0.05, 10)).astype(np.float32).tolist(), 1) for i in range(400)]
    got = rows_by_id(embeddings.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "vec_id")
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == _plain_vectors(rows)
    assert seen[0] < 0.5 * 50 * 51 / 2, seen
