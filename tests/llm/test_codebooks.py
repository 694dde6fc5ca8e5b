"""Vector codes against whole numbers in plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import codebooks

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    choose = lambda v, p: min(range(len(books[p])), key=lambda e: (apart(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [choose(v, p) for _, v, _ in kept]
            new.append([[sum(c) // len(c) for c in zip(*(cut(v, p) for (_, v, _), o in zip(kept, own) if o == e))] or books[p][e] for e in range(len(books[p]))])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, labels = [], {}
    for i, v, lab in kept:
        code = [choose(v, p) for p in range(parts)]
        error = sum(apart(cut(v, p), books[p][c]) for p, c in enumerate(code))
        labels[lab] = labels.get(lab, 0) + error
        out.append((i, "".join(f"{c:02x}" for c in code), error, lab))
    return sorted((str((i, c, e, labels[lab], digest)) for i, c, e, lab in out))


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS).repartition(3).withColumns({c: F.lit("clash") for c in ("v", "x", "mark", "code", "error", "rows")})
    return sorted(str(tuple(r)) for r in codebooks.compress(df, **options).collect())


def make(rng, n, dim=16):
    rows = [(k, [rng.gauss(rng.randrange(3), 0.2) for _ in range(dim)], rng.choice([0, 1, None])) for k in range(n)]
    nan, inf = float("nan"), float("inf")
    bad = [(-5, None, 1), (-4, [nan] * dim, 1), (-3, [0.0] * (dim - 1) + [inf], 1), (-2, [None] * dim, 1), (-1, [-inf] + [0.0] * (dim - 1), 2)]
    return rows + bad + rows[:2] + [(None, rows[5][1], None), (0, rows[3][1], 5)]


@pytest.mark.parametrize("n", [0, 1, 9, 120])
def test_codes_equal_brute_force(spark, n):
    rows = make(random.Random(n), n) if n > 5 else [(k, [0.5 * k] * 8, None) for k in range(n)]
    assert got(spark, rows) == brute(rows)


def test_ties_and_ragged_vectors(spark):
    ties = [(k, [float(k % 3)] * 8, k % 2) for k in range(40)]  # equal entries: the first is taken, the others stay unused
    assert got(spark, ties) == brute(ties)
    ragged = [(k, [0.25 * k] * (1 + k % 11), 0) for k in range(25)] + [(99, [], 0)]
    assert got(spark, ragged, parts=4, entries=3, rounds=2) == brute(ragged, 4, 3, 2)
    assert got(spark, [(1, [], 0), (2, None, 0)]) == brute([(1, [], 0), (2, None, 0)]) and len(brute([(1, [], 0)])) == 1


def test_label_sums_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = make(random.Random(3), 60)
    wanted = brute(rows)
    monkeypatch.setattr(codebooks, "BROADCAST_ROWS", 0)
    assert got(spark, rows) == wanted


def test_components_beyond_exact_squares_are_refused(spark):
    with pytest.raises(Exception, match="can't be squared exactly"):
        got(spark, [(1, [1e30] * 8, 0)])
    edge = [(k, [(-1.0) ** k * 16383.9] * 8, 0) for k in range(20)]
    assert got(spark, edge) == brute(edge)


def test_decoded_vectors_have_the_stated_error():
    rng = np.random.default_rng(1)
    x, books = rng.integers(-4096, 4096, (50, 32)), rng.integers(-4096, 4096, (8, 16, 4))
    codes, errors = codebooks.nearest(x, books)
    for v, c, e in zip(x, codes, errors):
        assert ((v - codebooks.decode(bytes(c.astype(np.uint8)).hex(), books)) ** 2).sum() == e.sum()
