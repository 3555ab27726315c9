"""The hash tree against a plain one."""

import hashlib
import zlib

import pytest

from evidra.llm import merkle
from tests.conftest import DATA
from tests.llm.helpers import odd_documents


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows, one list a level."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: h(*map(field, (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])))

    def up(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def beside(levels, i):
        return [level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else None for k, level in enumerate(levels[:-1])]

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: up([leaf(r) for r in groups[g]]) for g in langs}
    top = up([trees[g][-1][0] for g in langs])
    out = []
    for at, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node, siblings = leaf(r, 1 if hit else 0), []
            for spot, steps in ((i, beside(trees[g], i)), (at, beside(top, at))):
                for k, s in enumerate(steps):
                    siblings.append(s or "")
                    node = h(s or "", node) if spot >> k & 1 else h(node, s or "")
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(*siblings), node))
    return out


def same(got, rows):
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(plain(rows), key=repr)
    for r in got:
        assert r["verified"] == (r["folded_root"] == r["root"])


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_blocks_of_any_height(spark, levels):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = merkle.verify(docs, merkle.tampered(), levels).collect()
    same(got, [r.asDict() for r in docs.collect()])
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    same(merkle.verify(docs, merkle.tampered(), 2).collect(), [r.asDict() for r in docs.collect()])
    assert merkle.verify(docs.where("false"), merkle.tampered()).collect() == []


def test_one_leaf(spark):
    docs = odd_documents(spark).where("doc_id = 5")
    row = merkle.verify(docs, merkle.tampered()).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest() and row["verified"]


def test_versions_share_what_is_untouched():
    tree = merkle.Tree([merkle.digest(str(i)) for i in range(21)])
    nodes = len(tree.digests)
    first = tree.changed(20, merkle.digest("x"))
    second = tree.changed(3, merkle.digest("y"), first[-1])
    assert len(tree.digests) == nodes + len(first) + len(second) and len(first) == tree.height + 1
    leaves = [merkle.digest(str(i)) for i in range(20)] + [merkle.digest("x")]
    assert tree.digests[first[-1]] == merkle.Tree(leaves).digests[merkle.Tree(leaves).root]
    leaves[3] = merkle.digest("y")
    assert tree.digests[second[-1]] == merkle.Tree(leaves).digests[merkle.Tree(leaves).root]
    assert set(tree.path(0, first[-1])) & set(tree.path(0)) and tree.digests[tree.root] != tree.digests[first[-1]]
    for place in (0, 7, 20):
        up = merkle.ancestors(tree.digests[place], place, 21, iter(tree.siblings(place)))
        assert up[-1] == tree.digests[tree.root]


def test_copied_nodes_of_a_version(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    for r in merkle.manifest(docs, merkle.tampered(), 3).where("copied is not null").collect():
        depth = (r["n"] - 1).bit_length() + (r["langs"] - 1).bit_length()
        assert len(r["copied"]) == depth + 1 and r["copied"][0] != r["leaf"] and r["copied"][-1] != r["root"]
