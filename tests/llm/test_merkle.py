"""The Merkle manifest against a tree built level by level."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def leaf(r, plus=0):
    i, t, lang, s, n = r
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return merkle.sha(part(i) + part(s) + part(lang) + part(None if n is None else n + plus) + part(t))


def brute_paths(nodes):
    """(root, path of each leaf) by whole levels."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            s = p ^ 1
            paths[k].append((p, nodes[s] if s < len(nodes) else None))
        nodes = [merkle.sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        at = [p >> 1 for p in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = (own, *brute_paths([leaf(r) for r in own]))
    root, tops = brute_paths([trees[g][1] for g in order])
    out = []
    for g, top in zip(order, tops):
        own, subroot, paths = trees[g]
        for r, path in zip(own, paths):
            path = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            d = leaf(r, 1 if tampered else 0)
            for place, sibling in path:
                d = merkle.sha((sibling or "") + d if place & 1 else d + (sibling or ""))
            proof = merkle.sha("".join(s for _, s in path if s))
            out.append((r[0], leaf(r), subroot, root, proof, d, d == root))
            assert d == root or tampered
    return out


@pytest.mark.parametrize("n", [*range(1, 20), 31, 32, 33, 63, 64, 65, 100, 127, 128])
def test_fractal_traversal_equals_whole_levels(n):
    nodes = [merkle.sha(str(k)) for k in range(n)]
    root, paths = brute_paths(nodes)
    height = merkle.block_height(n, 7, True)
    wanted = [[merkle.ALONE if s is None else (merkle.LEFT if p & 1 else merkle.RIGHT) + s for p, s in path] for path in paths]
    for subtree in (1, 2, 3, 5):
        assert list(merkle.fractal_paths(nodes, height, subtree)) == wanted
    assert merkle.block_root(nodes, height) == root
    assert all(merkle.fold_path(d, p) == root for d, p in zip(nodes, wanted))


def test_traversal_keeps_few_nodes_and_steps():
    steps, most = [0], [0]
    real = merkle.treehash

    def counted(leaf_at, first, last, top, base, keep):
        inner = real(leaf_at, first, last, top, base, keep)
        while True:
            try:
                next(inner)
            except StopIteration as e:
                return e.value
            steps[0] += 1
            most[0] = max(most[0], len(keep))
            yield

    merkle.treehash = counted
    try:
        n = 1 << 12
        assert sum(1 for _ in merkle.fractal_paths(["0" * 64] * n, 12, 3)) == n
    finally:
        merkle.treehash = real
    assert most[0] <= 14 and steps[0] <= n * 2 * 4 + 2 * 2 * n  # a storey's nodes; two steps a leaf and storey, and the first subtrees


def make(rng, n):
    rows = []
    for k in range(n):
        t = rng.choice([None, "", "é" * rng.randrange(5), "x" * rng.randrange(50)])
        rows.append((rng.choice([None, k, k, k, k // 2]), t, rng.choice(["en"] * 6 + ["de", "fr", "", None, "é"]), rng.choice([None, "s:1", "a"]), rng.choice([None, k, 2**63 - 1])))
    return rows + rows[:3]


@pytest.mark.parametrize("height", [1, 2, 4, 12])
def test_manifest_equals_brute_force(spark, height):
    rows = make(random.Random(height), 150)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("clash") for c in ("tree", "place", "node", "path", "size", "key", "leaf", "changed", "_tie")})
    got = merkle.verified(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, height).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_small_and_empty_tables(spark):
    never = F.lit(False)
    for rows in ([(None, None, None, None, None)], [(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (1, "a", None, "s", 1)], [(1, "a", "en", "s", 1)] * 9):
        got = merkle.verified(spark.createDataFrame(rows, DOCS), never, 2).collect()
        assert sorted(map(repr, ((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got))) == sorted(repr(b[:5]) for b in brute(rows)) and all(r["verified"] for r in got)
    assert merkle.verified(spark.createDataFrame([], DOCS), never).collect() == []
