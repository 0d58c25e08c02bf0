"""Synthetic minority rows (ML16): exact nearest neighbours inside a class, seeded interpolation.

The k nearest neighbours of a row are the k other rows of the class with the smallest (distance,
key).  They are found exactly, without comparing all pairs:

1. equal feature vectors are one *point* (with its k + 1 smallest keys), so a vector that half of
   the class shares is searched once;
2. points are dealt to the nearest of a set of pivots, and a pivot's points to blocks of at most
   ``block`` (a pivot's cell may be hot); a block compares its points among themselves, which bounds
   how far the k-th neighbour of each can be;
3. a point visits every other block that may hold something nearer: by the triangle inequality,
   those whose pivot is not further than its bound plus the block's radius;
4. each visited block returns its best k + 1 (distance, key), and these are merged.

There is no cap on candidates.  Pivots grow with the points (one for each ``block``) up to
``MOST_PIVOTS``, which bounds what each task holds; beyond it cells have more blocks.  How many
blocks a point visits depends on the data: few in few dimensions, all of them at worst.

Blocks are screened by matrix products; distances are then summed feature by feature in order, so
they do not depend on the blocks and ties are ties.
"""

from __future__ import annotations

import sys
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import written
from ..plans.ranks import running_totals
from .split import key_hash

# the numpy functions below run in workers that may lack this package: shipped by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_PIVOTS = 16_384
_FOUND = "pid bigint, d2 double, nkey string, npid bigint"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed feature by feature in order."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for i in range(x.shape[-1]):
        diff = x[..., i] - y[..., i]
        out = out + diff * diff
    return out


def nearest(probe: np.ndarray, pids: np.ndarray, held: np.ndarray, held_pid: np.ndarray, held_keys: list, k: int,
            bound: np.ndarray | None = None, slab: int = 256) -> pd.DataFrame:
    """For each probe the first k + 1 keys of the held points by (distance, key).

    Products give approximate distances; every point within the (k + 1)-th of them, plus their
    rounding, is summed exactly.  With ``bound`` (squared), points beyond it are left out."""
    out = []
    mid = held.mean(axis=0)  # products of centred vectors lose less
    centred = held - mid
    norm = (centred * centred).sum(axis=1)
    most = min(k + 1, len(held))
    for a in range(0, len(probe), slab):
        x = probe[a:a + slab]
        xc = x - mid
        xn = (xc * xc).sum(axis=1)
        near = xn[:, None] + norm[None, :] - 2 * (xc @ centred.T)
        slack = 1e-9 * (xn[:, None] + norm.max(initial=0.0)) + 1e-300
        reach = np.partition(near, most - 1, axis=1)[:, most - 1:most] + 2 * slack
        if bound is not None:
            reach = np.minimum(reach, bound[a:a + slab, None] + 2 * slack)
        row, col = np.nonzero(near <= reach)
        exact = squared(x[row], held[col])
        for i, lo, hi in _runs(row):
            best = sorted((exact[j], key, held_pid[col[j]]) for j in range(lo, hi) for key in held_keys[col[j]])[:k + 1]
            out += [(pids[a + i], d, key, p) for d, key, p in best]
    return pd.DataFrame(out, columns=["pid", "d2", "nkey", "npid"])


def _runs(sorted_ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_ids)) + 1
    starts = [0, *cuts] if len(sorted_ids) else []
    for lo, hi in zip(starts, [*cuts, len(sorted_ids)]):
        yield int(sorted_ids[lo]), int(lo), int(hi)


def points(rows: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """(pid, x, keys): distinct vectors of ``rows(key, x)`` with their k + 1 smallest keys."""
    salted = Window.partitionBy("x", "salt").orderBy("key")
    first = (rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
             .withColumn("nth", F.row_number().over(salted)).filter(F.col("nth") <= k + 1))
    whole = Window.partitionBy("x").orderBy("key")
    few = first.withColumn("nth", F.row_number().over(whole)).filter(F.col("nth") <= k + 1)
    return few.groupBy("x").agg(F.sort_array(F.collect_list("key")).alias("keys")).withColumn("pid", F.monotonically_increasing_id())


def neighbours(rows: DataFrame, k: int = 5, block: int = 2_048, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, found) of ``rows(key string, x array<double>)``: ``found(pid, near)`` holds for each point
    the first k + 1 (d2, nkey, npid) of the class, its own keys among them."""
    pts = written(points(rows, k), "smote-points")
    n = pts.count()
    if n == 0:
        return pts, pts.select("pid", F.array(F.struct(F.lit(0.0).alias("d2"), F.lit("").alias("nkey"), F.col("pid").alias("npid"))).alias("near"))
    count = min(pivots or -(-n // block), MOST_PIVOTS, n)
    rate = min(1.0, 4 * count / n)
    h = F.pmod(F.xxhash64("x"), F.lit(1 << 30))
    sample = [r.x for r in pts.filter(h < F.lit(int(rate * (1 << 30)))).orderBy(h, "pid").limit(count).collect()]  # bounded
    pivot = np.array(sample or [pts.first().x], dtype=np.float64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["x"].tolist(), dtype=np.float64)
                cell, far = [], []
                for a in range(0, len(x), 256):
                    d = squared(x[a:a + 256, None, :], pivot[None, :, :])
                    cell += d.argmin(axis=1).tolist()
                    far += np.sqrt(d.min(axis=1)).tolist()
                yield pd.DataFrame({"pid": pdf["pid"], "x": pdf["x"], "keys": pdf["keys"], "cell": cell, "far": far})

    dealt = written(pts.select("pid", "x", "keys").mapInPandas(
        deal, "pid bigint, x array<double>, keys array<string>, cell int, far double"), "smote-cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row a pivot
    placed = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("pid"), "blocks").cast("int")).drop("blocks")
    placed = written(placed, "smote-blocks")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].tolist(), dtype=np.float64)
        return nearest(x, pdf["pid"].to_numpy(), x, pdf["pid"].to_numpy(), pdf["keys"].tolist(), k)

    first = written(placed.groupBy("cell", "part").applyInPandas(own, _FOUND), "smote-own")
    # the bound of a point: its (k + 1)-th distance so far, none where the block has too few keys
    reach = first.groupBy("pid").agg(F.when(F.count("*") > k, F.max("d2")).alias("bound"))
    radius = [(r["cell"], r["part"], r["r"]) for r in placed.groupBy("cell", "part").agg(F.max("far").alias("r")).collect()] \
        if n <= block * MOST_PIVOTS else None  # a row a block: at most 2 * MOST_PIVOTS here
    probes = placed.join(reach, "pid")
    schema = "pid bigint, x array<double>, bound double, cell int, part int"
    if radius is not None:
        cells = np.array([c for c, _, _ in radius])
        parts, radii = np.array([p for _, p, _ in radius]), np.array([r for _, _, r in radius])

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 256):
                    s = pdf.iloc[a:a + 256]
                    x = np.array(s["x"].tolist(), dtype=np.float64)
                    d = np.sqrt(squared(x[:, None, :], pivot[None, :, :]))[:, cells]
                    u = np.sqrt(np.where(s["bound"].isna(), np.inf, s["bound"]))[:, None]
                    go = d * (1 - 1e-12) <= (u + radii[None, :]) * (1 + 1e-12)
                    go &= (cells[None, :] != s["cell"].to_numpy()[:, None]) | (parts[None, :] != s["part"].to_numpy()[:, None])
                    row, col = np.nonzero(go)
                    yield pd.DataFrame({"pid": s["pid"].to_numpy()[row], "x": s["x"].to_numpy()[row], "bound": s["bound"].to_numpy()[row],
                                        "cell": cells[col], "part": parts[col]})

        sent = probes.select("pid", "x", "bound", "cell", "part").mapInPandas(visits, schema)
    else:  # more blocks than fit a table on the driver: every block of a cell within reach of the cell's radius
        far = placed.groupBy("cell").agg(F.max("far").alias("r"), (F.max("part") + 1).alias("blocks"))
        wide = far.collect()  # a row a pivot
        cells, radii = np.array([r["cell"] for r in wide]), np.array([r["r"] for r in wide])

        def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 256):
                    s = pdf.iloc[a:a + 256]
                    x = np.array(s["x"].tolist(), dtype=np.float64)
                    d = np.sqrt(squared(x[:, None, :], pivot[None, :, :]))[:, cells]
                    u = np.sqrt(np.where(s["bound"].isna(), np.inf, s["bound"]))[:, None]
                    row, col = np.nonzero(d * (1 - 1e-12) <= (u + radii[None, :]) * (1 + 1e-12))
                    yield pd.DataFrame({"pid": s["pid"].to_numpy()[row], "x": s["x"].to_numpy()[row], "bound": s["bound"].to_numpy()[row],
                                        "cell": cells[col], "part": -1, "home": s["cell"].to_numpy()[row], "at": s["part"].to_numpy()[row]})

        near = probes.select("pid", "x", "bound", "cell", "part").mapInPandas(reachable, schema + ", home int, at int")
        sent = (near.drop("part").join(F.broadcast(far.select("cell", "blocks")), "cell")
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .filter((F.col("cell") != F.col("home")) | (F.col("part") != F.col("at"))).select("pid", "x", "bound", "cell", "part"))
    # probes of a block are dealt over lanes, and the block goes to each lane
    sent = written(sent, "smote-probes")
    lanes = sent.groupBy("cell", "part").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("lanes"))
    probe = sent.join(lanes, ["cell", "part"]).select(
        "cell", "part", F.pmod(F.xxhash64("pid"), "lanes").cast("int").alias("lane"), "pid", "x", "bound")
    held = placed.join(lanes, ["cell", "part"]).select(
        "cell", "part", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "pid", "x", "keys")

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["pid", "d2", "nkey", "npid"])
        bound = np.where(left["bound"].isna(), np.inf, left["bound"].to_numpy(dtype=np.float64))
        return nearest(np.array(left["x"].tolist(), dtype=np.float64), left["pid"].to_numpy(),
                       np.array(right["x"].tolist(), dtype=np.float64), right["pid"].to_numpy(), right["keys"].tolist(), k, bound)

    key = ["cell", "part", "lane"]
    second = probe.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(visit, _FOUND)
    order = Window.partitionBy("pid").orderBy("d2", "nkey")
    best = first.unionByName(second).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    found = best.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("d2", "nkey", "npid"))).alias("near"))  # k + 1 each
    return pts, found


def _draw(seed: int, what: str) -> Column:
    """A whole number below 2^32 from seed, purpose, key and sample number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), "key", F.col("sample").cast("string"))), 1, 8), 16, 10).cast("long")


def smote(df: DataFrame, keys: list[str], features: list[str], label: str = "failure", minority=1, k: int = 5,
          ratio: float = 1.0, seed: int = 42, block: int = 2_048, pivots: int | None = None) -> DataFrame:
    """Synthetic rows of the minority class: (key, sample, neighbour, weight, features, label).

    The class is filled up to ``ratio`` times the rest of the labelled rows: each of its n rows gives
    N div n samples, and the first N mod n in the order of a key hash one more.  A sample lies
    between its row and one of the row's k nearest neighbours, both drawn by a hash of seed, key
    and sample number, so recomputed tasks draw alike.

    ``key`` is the row's keys as text, joined by ``|`` (they name a row; of rows with equal keys and
    features one is used).  Rows with a null or NaN feature take no part.  A class of one row has no
    neighbours and gives nothing, nor does an empty one.  Unlabelled rows count nowhere."""
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])  # -0.0 and 0.0 are one value
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features]
    rows = df.filter(F.col(label) == minority)
    for w in whole:
        rows = rows.filter(w)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    rows = written(rows.select(text.alias("key"), x.alias("x")).distinct(), "smote-rows")
    n = rows.count()
    others = df.filter(F.col(label).isNotNull() & (F.col(label) != minority)).count()
    total = max(0, int(ratio * others) - n) if n > 1 else 0
    pts, found = neighbours(rows, k, block, pivots)
    ranked = running_totals(rows.withColumn("hash", key_hash(["key"], seed)), ["hash", "key"], {"nth": F.lit(1)})
    each = F.lit(total // max(1, n)) + (F.col("nth") <= total % max(1, n)).cast("int")
    samples = ranked.withColumn("n", each.cast("int")).filter("n > 0").withColumn("sample", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = samples.join(pts.select("x", "pid"), "x").join(found, "pid")
    others_of = F.slice(F.filter("near", lambda s: s["nkey"] != F.col("key")), 1, k)
    drawn = met.withColumn("near", others_of).filter(F.size("near") > 0).withColumn(
        "chosen", F.get("near", (_draw(seed, "n") % F.size("near")).cast("int")))
    ends = pts.select(F.col("pid").alias("npid"), F.col("x").alias("y"))
    weight = _draw(seed, "w") / F.lit(4294967296.0)
    out = (drawn.select("key", "sample", F.col("chosen.nkey").alias("neighbour"), F.col("chosen.npid").alias("npid"), "x", weight.alias("weight"))
           .join(ends, "npid"))
    mixed = [(F.get("x", F.lit(i)) + F.col("weight") * (F.get("y", F.lit(i)) - F.get("x", F.lit(i)))).alias(c) for i, c in enumerate(features)]
    return out.select("key", "sample", "neighbour", "weight", *mixed, F.lit(minority).cast(df.schema[label].dataType).alias(label))
