"""Embedding near-dedup (operator 5): spherical k-means cells, blocked cosine products.

Vectors are compared only when their labels are equal and not null (and their lengths equal).
Equal vectors are one *class*.  Spherical k-means on a bounded sample gives unit centroids;
every class has its home in the cell with the largest cosine.  The cells lose nothing: unit
vectors with cosine c are sqrt(2 - 2c) apart, so a vector of cell A can only be linked into
cell B if it lies within that distance of the plane between the two centroids, and it is
sent to every lower-numbered cell for which that holds.  Cells are cut into blocks; each pair of
blocks is one matrix product in double precision, which yields link counts and a spanning
forest of its links, never the list of them.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do
those with a null label.  Repeated rows are copies; rows with a null id take part and are never
the smallest id.  An empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written
from .components import components
from .minhash import grouped

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of one block of a matrix product.
BLOCK = 1_024
#: Vectors that k-means is fitted on at most, target size of a cell, and most cells.
SAMPLE, CELL, MOST_CELLS = 16_384, 1_000, 1_024


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, or None where it links with nothing."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    return v if np.isfinite(v).all() and 0 < np.sqrt((v * v).sum()) < np.inf else None


def unit_rows(raw: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k unit centroids (fewer where the sample has fewer different vectors)."""
    rng = np.random.default_rng(seed)
    c = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        home = np.concatenate([(x[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def fit_cells(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, from the ``SAMPLE`` classes with the smallest digests."""
    rows = classes.orderBy("d1", "d2").limit(SAMPLE).select("dim", "raw").collect()  # bounded
    by: dict[int, list[bytes]] = {}
    for r in rows:
        by.setdefault(r["dim"], []).append(bytes(r["raw"]))
    k = min(MOST_CELLS, max(1, n // CELL))
    return {d: spherical_kmeans(unit_rows(v), min(k, max(1, len(v) // 8))) for d, v in by.items()}


def _classes(rows: DataFrame) -> DataFrame:
    """Rows with a usable vector: (vec_id, label, dim, d1, d2, raw); others have a null raw."""
    def one(cols: dict) -> dict:
        out: dict[str, list] = {"vec_id": cols["vec_id"], "label": cols["label"], "dim": [], "d1": [], "d2": [], "raw": []}
        for label, vector in zip(cols["label"], cols["embedding"]):
            v = None if label is None else usable(vector)
            if v is None:
                d1 = d2 = raw = dim = None
            else:
                raw, dim = (v + 0.0).tobytes(), len(v)  # -0.0 is 0.0
                d1, d2 = np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), "<i8").tolist()
            for n, x in zip(("dim", "d1", "d2", "raw"), (dim, d1, d2, raw)):
                out[n].append(x)
        return out

    return map_arrow(rows, one, "vec_id bigint, label string, dim int, d1 bigint, d2 bigint, raw binary")


def placed(classes: DataFrame, cells: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """One row for the home of a class (side 0), and one for each lower cell near it (side 1)."""
    shared = classes.sparkSession.sparkContext.broadcast(cells)  # at most MOST_CELLS centroids a length
    reach = float(np.sqrt(2 - 2 * cosine))

    def one(cols: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("label", "dim", "cell", "side", "cid", "copies", "raw")}
        dims = np.array(cols["dim"])
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d).tolist()
            c = shared.value.get(d, np.zeros((1, d)))
            dots = unit_rows([cols["raw"][i] for i in at]) @ c.T
            home = dots.argmax(axis=1)
            apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
            near = (dots[np.arange(len(at)), home][:, None] - dots <= reach * apart[home] + 1e-9) & (np.arange(len(c)) < home[:, None])
            for i, h, row in zip(at, home.tolist(), near):
                for cell, side in [(h, 0), *((int(b), 1) for b in np.flatnonzero(row))]:
                    for n, x in zip(out, (cols["label"][i], d, cell, side, cols["cid"][i], cols["copies"][i], cols["raw"][i])):
                        out[n].append(x)
        return out

    return map_arrow(classes.select("label", "dim", "cid", "copies", "raw"), one,
                     "label string, dim int, cell int, side int, cid bigint, copies bigint, raw binary")


def forest(links: np.ndarray) -> np.ndarray:
    """Smallest member reachable for each of n members of a symmetric link matrix."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_links(work: DataFrame, cosine: float) -> DataFrame:
    """For each pair of blocks: (cid, n, root): links of a class, weighted by copies, and a class
    it is linked with directly or through others."""
    def run(batches):
        for rows in grouped(batches, ["label", "dim", "cell", "i", "j"]):
            raw = unit_rows([r["raw"] for r in rows])
            part = np.array([r["part"] for r in rows])
            cid, copies = np.array([r["cid"] for r in rows]), np.array([r["copies"] for r in rows], np.float64)
            a, b = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
            if not len(b):  # a block with itself
                hit = raw[a] @ raw[a].T >= cosine
                np.fill_diagonal(hit, False)
                n, links = hit @ copies[a], hit
            else:
                hit = raw[a] @ raw[b].T >= cosine
                n = np.concatenate([hit @ copies[b], hit.T @ copies[a]])
                links = np.zeros((len(rows), len(rows)), bool)
                links[:len(a), len(a):], links[len(a):, :len(a)] = hit, hit.T
            order = np.concatenate([a, b])
            some = np.flatnonzero(n > 0)
            if len(some):
                root = forest(links[np.ix_(some, some)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[order][some]), pa.array(n[some].astype(np.int64)), pa.array(cid[order][some][root])], names=["cid", "n", "root"])

    return (work.repartition("label", "dim", "cell", "i", "j").sortWithinPartitions("label", "dim", "cell", "i", "j")
            .mapInArrow(run, "cid bigint, n bigint, root bigint"))


def linked(classes: DataFrame, cosine: float) -> DataFrame:
    """(cid, n, root) of all pairs of blocks."""
    cells = fit_cells(classes, classes.count())
    rows = written(placed(classes, cells, cosine), "placed")
    key = ["label", "dim", "cell"]
    size = rows.groupBy(*key).agg(F.sum((F.col("side") == 0).cast("long")).alias("h"), F.sum((F.col("side") == 1).cast("long")).alias("p"))
    size = written(size.where("h > 0").select(*key, F.ceil(F.col("h") / BLOCK).cast("int").alias("hb"),
                                              F.greatest(F.lit(1), F.ceil(F.col("p") / BLOCK)).cast("int").alias("pb")), "sizes")
    dealt = rows.join(size, key)
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("side") == 0, F.col("hb")).otherwise(F.col("pb"))).cast("int")
    dealt = dealt.withColumn("own", own)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = dealt.where("side = 0")
    # home blocks with each other (i <= j), then probe blocks (numbered from hb on) with home blocks
    hh = homes.withColumn("o", every("hb")).select(
        *key, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("part"), "cid", "copies", "raw")
    met = dealt.where("side = 1").select(*key).distinct()
    hp = homes.join(written(met, "met"), key).withColumn("o", every("pb")).select(
        *key, F.col("own").alias("i"), (F.col("hb") + F.col("o")).alias("j"), F.lit(0).alias("part"), "cid", "copies", "raw")
    pp = dealt.where("side = 1").withColumn("o", every("hb")).select(
        *key, F.col("o").alias("i"), (F.col("hb") + F.col("own")).alias("j"), F.lit(1).alias("part"), "cid", "copies", "raw")
    return _block_links(hh.unionByName(hp).unionByName(pp), cosine)


def near_duplicates(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"),
                     F.col(f"`{label_col}`").cast("string").alias("label"))
    keyed = _classes(rows)
    same = ["label", "dim", "d1", "d2"]
    classes = written(keyed.where("raw is not null").groupBy(*same).agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("raw").alias("raw"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")  # numbered once, as written
    found = written(linked(classes, cosine), "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = (classes.drop("raw").join(counts, "cid", "left")
             .join(comp.select(F.col("node").alias("cid"), "component"), "cid", "left")
             .withColumn("component", F.coalesce("component", "cid")))
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    named = written(named.join(ids, "component").select(
        *same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id"), "named")
    out = keyed.drop("raw").join(named, same, "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))
