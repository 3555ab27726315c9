"""Token files against the tokenizer, and wavelet matrices against arrays."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidra.llm import tokenids
from evidra.llm.wavelet import Matrix, Plane, Shard
from tests.conftest import DATA
from tests.llm.helpers import documents, odd_documents


def plain(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard", [300, 1 << 20])
def test_files_hold_all_ids(spark, shard):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    folder, shards = tokenids.write(docs, shard=shard)
    got = sorted(map(tuple, tokenids.read(spark, folder, shards).collect()))
    assert got == plain(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    want = np.concatenate([Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(r["text"], add_special_tokens=False).ids for r in docs.collect() if r["text"]])
    asked = [2, 13, 262, 40_000]
    n = {r["token"]: r["n"] for r in tokenids.count(spark, folder, asked).collect()}
    assert [n[t] for t in asked] == [int((want == t).sum()) + (docs.count() if t == 2 else 0) for t in asked]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    folder, shards = tokenids.write(docs, shard=50)
    got = tokenids.read(spark, folder, shards).collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r) for r in sorted(got, key=lambda r: r["start"])] == plain(rows)
    folder, shards = tokenids.write(docs.where("false"))
    assert tokenids.read(spark, folder, shards).collect() == []


def test_occurrences_are_found(spark):
    docs = documents(spark, ["a b a", None, "c a", ""])
    folder, _ = tokenids.write(docs, shard=3)
    assert {tuple(r) for r in tokenids.find(spark, folder, 257).collect()} == {(0, 2), (2, 1)}
    assert tokenids.find(spark, folder, 9999).collect() == []


def test_plane():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        bits = rng.random(n) < 0.3
        p = Plane.of(bits)
        i = np.arange(n + 1)
        assert (p.ones(i) == np.concatenate([[0], np.cumsum(bits)])).all() and (p.bits() == bits).all()
        for bit in (0, 1):
            where = np.flatnonzero(bits == bit)
            assert [p.select(k, bit) for k in range(0, len(where), 7)] == where[::7].tolist()


@pytest.mark.parametrize(("n", "kinds"), [(0, 1), (1, 1), (40, 1), (1000, 2), (5000, 700), (20_000, 50_000)])
def test_shard_answers_like_an_array(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum((kinds * rng.random(n) ** 4).astype(np.int64), kinds - 1)
    ends = np.array([n // 2, n // 2, n])
    s = Shard.from_bytes(Shard.of(7, ids, [3, None, -1], ends).to_bytes())
    assert (s.decode() == ids).all() and s.doc_ids == [3, None, -1] and s.number == 7 and (s.ends == ends).all()
    some = rng.integers(0, n, 200) if n else np.zeros(0, np.int64)
    assert (s.access(some) == ids[some]).all() and (s.document(2) == ids[n // 2 :]).all() and len(s.document(1)) == 0
    for t in [*ids[:20].tolist(), *np.unique(ids)[-5:].tolist(), kinds + 5]:
        where = np.flatnonzero(ids == t)
        assert s.count(t) == len(where) and s.count(t, n // 3, n // 2) == int(((where >= n // 3) & (where < n // 2)).sum())
        assert [s.occurrence(t, k) for k in range(min(5, len(where)))] == where[:5].tolist() and s.occurrence(t, len(where)) == -1


def test_matrix_ranks():
    codes = np.random.default_rng(5).integers(0, 13, 3000).astype(np.uint16)
    m = Matrix.of(codes, 4)
    i = np.arange(0, 3001, 11)
    for c in range(13):
        assert (m.rank(c, i) == np.concatenate([[0], np.cumsum(codes == c)])[i]).all()
        assert m.select(c, 3) == np.flatnonzero(codes == c)[3]


def test_files_are_small():
    rng = np.random.default_rng(2)
    ids = np.minimum((3000 * rng.random(200_000) ** 3).astype(np.int64), 2999)
    assert len(Shard.of(0, ids, [0], np.array([len(ids)])).to_bytes()) < 0.45 * 4 * len(ids)
