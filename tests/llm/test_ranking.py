"""Ranked search against brute force, and the treap against arrays."""

import heapq
import math
import re
from collections import Counter

import numpy as np
import pytest

from evidra.llm import ranking
from evidra.llm.treap import Treap
from tests.llm.helpers import documents, odd_documents


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute(docs, items, best=50):
    terms = lambda t: re.findall(TERM, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    held, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for d, c in counted:
            m = 50 + 50 * sum(c.values()) * held // total if total else 50
            score = sum(math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:best])]
    return sorted(out, key=repr)


def found(spark, docs, items, best=50):
    blocks, figures = ranking.index(docs)
    return sorted(map(tuple, ranking.search(blocks, figures, items, best).collect()), key=repr)


def test_odd_rows_and_ties(spark):
    docs = odd_documents(spark)
    long = docs.where("doc_id = 7").first()["text"]
    items = spark.createDataFrame([(1, long[:300]), (2, None), (3, ""), (4, "One, TWO three"), (4, "b"), (None, "no words ID"), (6, "ä中 x" + "x" * 10)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    asked = [tuple(r) for r in items.collect()]
    for best in (1, 3, 50):
        assert found(spark, docs, items, best) == brute(rows, asked, best)
    assert found(spark, docs.where("false"), items) == [] and found(spark, docs, items.where("false")) == []


def test_copies_tie_by_id(spark):
    texts = ["same words here", "other words"] * 90 + ["same words here too"]
    docs, items = documents(spark, texts), spark.createDataFrame([(7, "same here"), (8, "words"), (9, "other")], "item_id long, text string")
    assert found(spark, docs, items) == brute(list(enumerate(texts)), [(7, "same here"), (8, "words"), (9, "other")])


def test_parts_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ASKED", 4)
    texts = [f"w{i % 7} w{i % 11} w{i % 13}" for i in range(200)]
    asked = [(i, f"w{i} w{i + 3} q{i}") for i in range(9)]
    assert found(spark, documents(spark, texts), spark.createDataFrame(asked, "item_id long, text string")) == brute(list(enumerate(texts)), asked)


@pytest.mark.parametrize(("rows", "columns", "points"), [(1, 1, 1), (1, 40, 30), (40, 1, 30), (9, 9, 40), (500, 64, 3000), (5000, 300, 9000)])
def test_treap(rows, columns, points):
    rng = np.random.default_rng(points)
    cells = rng.choice(rows * columns, min(points, rows * columns), replace=False)
    r, c = cells // columns, cells % columns
    n = rng.integers(1, 9, len(cells))
    value = lambda n, c: 10 * n + c % 3
    treap = Treap.open(Treap.build(r, c, n, value(n, c)), value)
    grid = np.zeros((rows, columns), np.int64)
    grid[r, c] = value(n, c)
    asked = []
    for size in (0, 1, 2, 30):
        mine = rng.choice(rows, min(size, rows), replace=False)
        asked.append((mine, rng.integers(1, 50, len(mine))))
    for k in (1, 5, 1000):
        heaps = [[] for _ in asked]

        def take(q, column, score, k=k, heaps=heaps):
            heapq.heappush(heaps[q], (score, -column))
            if len(heaps[q]) > k:
                heapq.heappop(heaps[q])

        treap.best(asked, [lambda column, score, q=q: take(q, column, score) for q in range(len(asked))], [lambda h=h: h[0][0] if len(h) == k else 1 for h in heaps])
        for (mine, w), heap in zip(asked, heaps, strict=True):
            scores = (grid[mine] * w[:, None]).sum(0)
            want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:k]
            assert sorted(heap, reverse=True) == want


def test_bounds_spare_ranges():
    rng = np.random.default_rng(3)
    r, c = np.repeat(np.arange(64), 512), np.tile(np.arange(512), 64)
    n = np.where(c == 77, 100, rng.integers(1, 5, len(r)))
    treap = Treap.open(Treap.build(r, c, n, n), lambda n, c: n)
    seen = []
    treap.best([(np.array([3, 9]), np.array([1, 1]))], [lambda column, score: seen.append((score, column))], [lambda: max((s for s, _ in seen), default=1)])
    assert max(seen) == (200, 77) and len(seen) < 300
