"""SMOTE against a plain version: ties, equal vectors, hot vectors, tiny classes, missing features."""

import hashlib
import random

import pytest

from panelwise.operators.smote import neighbours, smote


def plain_neighbours(rows, k):
    out = {}
    for key, x in rows:
        near = sorted((sum_sq(x, y), other) for other, y in rows if other != key)
        out[key] = near[:k]
    return out


def sum_sq(x, y):
    s = 0.0
    for a, b in zip(x, y):
        s = s + (a - b) * (a - b)
    return s


def cloud(n, seed, dims=3, centres=6, copies=0):
    r = random.Random(seed)
    mids = [[r.uniform(-50, 50) for _ in range(dims)] for _ in range(centres)]
    rows = [(f"k{i:04d}", [round(c + r.gauss(0, 1), 1) for c in mids[i % centres]]) for i in range(n)]
    return rows + [(f"z{i:04d}", rows[0][1]) for i in range(copies)]


@pytest.mark.parametrize("rows, block, pivots", [
    (cloud(300, 1), 40, None), (cloud(300, 2), 16, 3), (cloud(60, 3, copies=90), 8, 5), (cloud(200, 4, dims=1, centres=2), 10, 40),
    ([(f"g{i:03d}", [float(i % 10), float(i // 10)]) for i in range(100)], 7, 9), (cloud(4, 5), 8, None), (cloud(1, 6), 8, None)])
def test_neighbours_are_exact(spark, rows, block, pivots):
    df = spark.createDataFrame(rows, "key string, x array<double>")
    pts, found = neighbours(df, 5, block, pivots)
    near = {r.pid: [(s.d2, s.nkey) for s in r.near] for r in found.collect()}
    pid = {tuple(r.x): r.pid for r in pts.collect()}
    assert len(pid) == len({tuple(x) for _, x in rows})
    for key, want in plain_neighbours(rows, 5).items():
        mine = near[pid[tuple(dict(rows)[key])]]
        assert [s for s in mine if s[1] != key][:5] == want


def test_a_hot_vector_is_searched_once(spark):
    """A third of the class shares one vector: one point, with k + 1 keys."""
    rows = [(f"h{i:05d}", [1.0, 2.0]) for i in range(3000)] + cloud(600, 7, dims=2)
    pts, _ = neighbours(spark.createDataFrame(rows, "key string, x array<double>"), 5, 64)
    got = pts.collect()
    assert len(got) == len({tuple(x) for _, x in rows}) and max(len(r["keys"]) for r in got) <= 6


def draw(what, key, sample):
    return int(hashlib.md5(f"42|{what}|{key}|{sample}".encode()).hexdigest()[:8], 16)


def test_samples(spark):
    rows = [(k, *x, 1) for k, x in cloud(40, 8)] + [(f"n{i}", float(i), 0.0, 0.0, 0) for i in range(130)]
    rows += [("gap", None, 1.0, 1.0, 1), ("nan", float("nan"), 1.0, 1.0, 1), ("open", 1.0, 1.0, 1.0, None), rows[0]]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double, y int")
    got = {(r.key, r["sample"]): (r.neighbour, r.a, r.b, r.c, r.y) for r in smote(df, ["id"], ["a", "b", "c"], "y", block=16).collect()}
    base = {r[0]: r[1:4] for r in rows[:40]}
    near = plain_neighbours(list(base.items()), 5)
    order = sorted(base, key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
    want = {}
    for i, key in enumerate(order):
        for s in range(90 // 40 + (i < 90 % 40)):
            other = near[key][draw("n", key, s) % 5][1]
            w = draw("w", key, s) / 4294967296
            want[key, s] = (other, *(x + w * (y - x) for x, y in zip(base[key], base[other])), 1)
    assert got == want and len(got) == 90
    again = smote(df.repartition(7), ["id"], ["a", "b", "c"], "y", block=8, pivots=4).collect()
    assert {(r.key, r["sample"]): (r.neighbour, r.a, r.b, r.c, r.y) for r in again} == want


def test_small_classes(spark):
    schema = "id string, a double, y int"
    none = spark.createDataFrame([], schema)
    assert smote(none, ["id"], ["a"], "y").count() == 0
    one = spark.createDataFrame([("p", 1.0, 1)] + [(f"n{i}", 2.0, 0) for i in range(9)], schema)
    assert smote(one, ["id"], ["a"], "y").count() == 0
    two = spark.createDataFrame([("p", 1.0, 1), ("q", 3.0, 1)] + [(f"n{i}", 2.0, 0) for i in range(9)], schema)
    out = smote(two, ["id"], ["a"], "y").collect()
    assert len(out) == 7 and all(1.0 <= r.a <= 3.0 and {r.key, r.neighbour} == {"p", "q"} for r in out)
    full = two.union(spark.createDataFrame([(f"p{i}", 1.0, 1) for i in range(9)], schema))
    assert smote(full, ["id"], ["a"], "y").count() == 0  # already as many
