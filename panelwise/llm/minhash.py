"""MinHash near-dedup (operator 3): circulant MinHash, banding, exact verification.

Two permutations make the whole signature: shingle hashes go through the first, and the
second, circularly shifted by 0, 1, 2, ..., gives one coordinate after another (the smallest
value over the set).  Five coordinates form a band; with 40 bands a pair at similarity 0.8
shares none with probability (1 - 0.8^5)^40 = 1.3e-7.

Texts with equal shingle sets are one *class*; classes, not copies, are linked:

1. In each band bucket every member is compared with the bucket's smallest member, on full
   sets.  Links are contracted to components.
2. Buckets that still hold several components compare the others with one pseudo-random
   member of the bucket's largest component; contracted again.
3. What is left is settled exactly: components that meet in a bucket are compared member by
   member, in blocks, except pairs of small ones whose signatures agree in under 62 % (five
   standard deviations below 0.8).

So no link is lost, and no stage lists the pairs inside a group of copies: a link table holds
at most one row for each member and partner *component*.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered.  A text with fewer words than the shingle
width is one shingle; null, empty and blank texts have none and link with nothing.  Repeated
rows are copies of each other; rows with a null id take part like any other and are never the
smallest id.  An empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BoundedMemo, map_arrow, mix64, text_rows, words_of, written
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Members compared in one block.
BLOCK = 512


# ---- sets and signatures -----------------------------------------------------------------

def word_hashes() -> BoundedMemo:
    return BoundedMemo(xxhash.xxh3_64_intdigest, 400_000)


def shingle_set(data: bytes, width: int, hashes: BoundedMemo) -> np.ndarray:
    """Sorted distinct 64-bit digests of the shingles of a text."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for i in range(min(width, len(h))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(out)


def _mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int, piece: int = 32_768) -> np.ndarray:
    """Circulant MinHash of non-empty sets: (len(sets), coordinates) 32-bit values.  The sets
    are laid end to end and handled in pieces that stay in the processor's cache."""
    out = np.full((len(sets), coordinates), np.uint32(0xFFFFFFFF))
    sizes = np.array([len(s) for s in sets])
    i = 0
    while i < len(sets):
        j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), piece, side="right")) + i)
        flat = np.concatenate(sets[i:j])
        starts = np.concatenate([[0], np.cumsum(sizes[i:j])[:-1]])
        first = _mix32((flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32))  # first permutation
        if j == i + 1:  # one long set, in pieces
            for a in range(0, len(first), piece):
                for k in range(coordinates):
                    v = _mix32(first[a:a + piece] + np.uint32(k)).min()
                    out[i, k] = min(out[i, k], v)
        else:
            for k in range(coordinates):
                out[i:j, k] = np.minimum.reduceat(_mix32(first + np.uint32(k)), starts)
        i = j
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band number is part of the key."""
    rows = sig.shape[1] // bands
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows].astype(np.uint64))
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist())


def signed_rows(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, version, n_shingles, c1, c2 (class), keys (bands), sig (low bytes); nulls for empty
    sets."""
    def one(cols: dict) -> dict:
        hashes = word_hashes()  # of this slice: a worker lives on through later stages and would keep it
        sets = [shingle_set(t.encode(), width, hashes) for t in cols["text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = signatures([sets[i] for i in full], bands * rows)
        keys, low = band_keys(sig, bands).astype(np.int64), sig.astype(np.uint8)
        out = {"doc_id": cols["doc_id"], "version": cols["version"], "n_shingles": [len(s) for s in sets]}
        blank: list = [None] * len(sets)
        c1, c2, k, g = blank[:], blank[:], blank[:], blank[:]
        for at, i in enumerate(full):
            c1[i], c2[i] = _digest(sets[i])
            k[i], g[i] = keys[at], low[at].tobytes()
        return {**out, "c1": c1, "c2": c2, "keys": k, "sig": g}

    return map_arrow(docs, one, "doc_id bigint, version bigint, n_shingles bigint, c1 bigint, c2 bigint, keys array<bigint>, sig binary")


# ---- comparison in blocks ----------------------------------------------------------------

class SetIndex:
    """Exact intersection sizes of one set with many, through a sorted list of all shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat)
        self.keys, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Members whose similarity with ``s`` is at least ``percent`` / 100."""
        lo, hi = np.searchsorted(self.keys, s, side="left"), np.searchsorted(self.keys, s, side="right")
        n = hi - lo
        lo, n = lo[n > 0], n[n > 0]
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.empty(0, int)
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((100 * both >= percent * (self.sizes + len(s) - both)) & (both > 0))


def grouped(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[list[dict]]:
    """Consecutive rows with equal ``key`` of a sorted partition, one list of rows a group."""
    held, last = [], None
    for b in batches:
        for row in b.to_pylist():
            k = tuple(row[c] for c in key)
            if k != last and held:
                yield held
                held = []
            last = k
            held.append(row)
    if held:
        yield held


def block_links(work: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of work rows (task, lane, side, cid, label, shingles): in each (task, lane)
    the rows of side 1 are compared with those of side 0; one link for each row and label."""
    def run(batches):
        a, b = [], []
        for rows in grouped(batches, ["task", "lane"]):
            index, seen = {r["cid"]: r for r in rows if r["side"] == 0}, set()
            if index:
                held = list(index.values())
                ix = SetIndex([np.frombuffer(r["shingles"], "<u8") for r in held])
                for r in rows:
                    if r["side"] == 1 and r["cid"] not in seen:
                        seen.add(r["cid"])
                        met = set()
                        for m in ix.linked(np.frombuffer(r["shingles"], "<u8"), percent):
                            other = held[m]
                            if other["cid"] != r["cid"] and other["label"] not in met:
                                met.add(other["label"])
                                a.append(r["cid"])
                                b.append(other["cid"])
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (work.select("task", "lane", "side", "cid", "label", "shingles").repartition("task", "lane")
            .sortWithinPartitions("task", "lane", "side").mapInArrow(run, "a bigint, b bigint"))


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links of distinct (hub, cid) pairs.  A hub's members are dealt over lanes of
    about a block each, and the hub's set goes to each lane."""
    lanes = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    hubs = written(pairs.groupBy("hub").agg(F.count("*").alias("n")).select("hub", lanes.alias("lanes")), "hubs")
    members = pairs.join(hubs, "hub").select(
        F.col("hub").alias("task"), F.pmod(F.xxhash64("cid"), "lanes").cast("int").alias("lane"), F.lit(1).alias("side"), "cid")
    centres = hubs.select(F.col("hub").alias("task"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"),
                          F.lit(0).alias("side"), F.col("hub").alias("cid"))
    work = members.unionByName(centres).join(sets, "cid").withColumn("label", F.lit(0).cast("long"))
    return block_links(work, percent)


# ---- the operator ------------------------------------------------------------------------

def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, label): the component of each node, itself where it has no link."""
    comp = components(links).select(F.col("node").alias("cid"), F.col("component").alias("label"))
    return written(nodes.join(comp, "cid", "left").select("cid", F.coalesce("label", "cid").alias("label")), "labels")


def _unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cid, label, main) of the buckets that hold several components; ``main`` is the
    bucket's most frequent one."""
    m = written(shared.join(labels, "cid"), "members")
    per = m.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
    main = written(main.where("labels > 1").select("key", F.col("top.label").alias("main")), "main")
    return m.join(main, "key")


def _close_pairs(others: DataFrame, bar: float, block: int = 2_048) -> DataFrame:
    """Pairs of labels, neither the bucket's main one, whose signatures agree enough somewhere in
    a bucket.  Only components that are still apart come here; a bucket with more than a
    block of them is compared block against block."""
    n = others.groupBy("key").agg(F.countDistinct("label").alias("labels"), F.count("*").alias("n")).where("labels > 1")
    n = written(n.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("cid"), "blocks").cast("int")
    dealt = others.join(n, "key").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = dealt.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "cid", "label", "sig")

    def run(batches):
        out = set()
        for rows in grouped(batches, ["key", "i", "j"]):
            sig = np.stack([np.frombuffer(r["sig"], np.uint8) for r in rows])
            label, own = np.array([r["label"] for r in rows]), np.array([r["own"] for r in rows])
            split = rows[0]["i"] != rows[0]["j"]
            for x in range(len(rows)):
                y = np.flatnonzero((label > label[x]) & ((own != own[x]) | (not split)))
                if len(y):
                    near = y[(sig[y] == sig[x]).mean(axis=1) >= bar]
                    out.update((int(label[x]), int(v)) for v in np.unique(label[near]))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["x", "y"])
                out = set()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["x", "y"])

    return work.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "x bigint, y bigint")


def _member_links(contacts: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compare components that met, member by member: the members of the smaller one go to
    blocks of the larger one."""
    size = written(labels.groupBy("label").agg(F.count("*").alias("n")), "sizes")
    c = (contacts.join(size.select(F.col("label").alias("x"), F.col("n").alias("nx")), "x")
         .join(size.select(F.col("label").alias("y"), F.col("n").alias("ny")), "y"))
    big = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    c = written(c.select(F.when(big, F.col("x")).otherwise(F.col("y")).alias("task"),
                         F.when(big, F.col("y")).otherwise(F.col("x")).alias("label"),
                         F.greatest("nx", "ny").alias("held")).distinct(), "contacts")
    probes = c.join(labels, "label").select("task", "held", "cid", "label")
    load = written(c.join(size, "label").groupBy("task").agg(F.max("held").alias("held"), F.sum("n").alias("probes"))
                   .select("task", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"),
                           F.ceil(F.col("probes") / (4 * BLOCK)).cast("int").alias("salts")), "load")
    left = probes.join(load, "task").select(
        "task", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("cid"), "salts").cast("int").alias("salt"), F.lit(1).alias("side"), "cid", "label")
    right = load.join(labels.withColumnRenamed("label", "task"), "task").select(
        "task", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), "cid", F.col("task").alias("label"))
    work = left.unionByName(right).withColumn("lane", F.col("block") * 1_000_003 + F.col("salt"))
    return block_links(work.join(sets, "cid"), percent)


def near_duplicates(df: DataFrame, width: int = 2, percent: int = 80, bands: int = 40, rows: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_classes, component, version of every document.

    ``n_classes`` counts the different shingle sets in its component, ``component`` tells
    components apart even where ids repeat (null for empty sets), ``version`` is xxhash64 of
    the text."""
    docs = text_rows(df, id_col, text_col, "doc_id").withColumn("version", F.xxhash64("text"))
    signed = written(signed_rows(docs, width, bands, rows), "signed")
    classes = written(
        signed.where("c1 is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"),
                                                              F.min(F.struct("doc_id", "version")).alias("at"),
                                                              F.first("sig").alias("sig"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes")  # numbered once, as written
    member = classes.select("cid", F.explode("keys").alias("key"))
    hubs = written(member.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("top"))
                   .where("hub < top").select("key", "hub"), "hubs")
    shared = written(member.join(hubs, "key"), "shared")  # buckets with two members or more
    nodes = written(shared.select("cid").distinct(), "nodes")
    sets = _sets(docs, classes.join(nodes, "cid").select("cid", "c1", "c2", F.col("at.doc_id").alias("at_id"),
                                                         F.col("at.version").alias("at_version")), width)

    links = written(star_links(shared.where("cid <> hub").select("hub", "cid").distinct(), sets, percent), "links")
    labels = _labelled(nodes, links)
    apart = _unsettled(shared.select("key", "cid"), labels)
    hub2 = written(apart.where("label = main").groupBy("key").agg(
        F.min_by("cid", F.xxhash64("cid", "key")).alias("hub")), "hub2")
    again = apart.where("label <> main").join(hub2, "key").select("hub", "cid").distinct()
    links = written(links.unionByName(star_links(again, sets, percent)), "links")
    labels = _labelled(nodes, links)

    apart = written(_unsettled(shared.select("key", "cid"), labels).where("label <> main"), "apart")
    with_main = apart.select(F.col("main").alias("x"), F.col("label").alias("y")).distinct()
    close = _close_pairs(apart.join(classes.select("cid", "sig"), "cid"), 0.62).distinct()
    links = links.unionByName(_member_links(with_main.unionByName(close), labels, sets, percent))
    comp = components(links).select(F.col("node").alias("cid"), "component")

    named = classes.select("cid", "c1", "c2", "least").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n_classes")), "ids")
    named = written(named.join(ids, "component").select("c1", "c2", "component_id", "n_classes", "component"), "named")
    out = signed.select("doc_id", "version", "n_shingles", "c1", "c2").join(named, ["c1", "c2"], "left")
    comp_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp_id, F.lit(False)).alias("kept"),
                      F.coalesce("n_classes", F.lit(0)).cast("long").alias("n_classes"), "component", "version")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``df``, all columns, with one row of each component: that of the smallest
    (id, version).  Rows with empty sets all stay."""
    found = near_duplicates(df, id_col=id_col, text_col=text_col, **settings)
    first = F.struct("doc_id", "version")
    winners = found.where("n_shingles > 0").groupBy("component").agg(F.min(first).alias("f")).select("f.*")
    blank = found.where("n_shingles = 0").select("doc_id", "version").distinct()
    stay = written(winners.withColumn("all", F.lit(False)).unionByName(blank.withColumn("all", F.lit(True))), "winners")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                     F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("version"))
    key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("k"), F.col("doc_id").isNull().alias("is_null"), "version"]
    met = rows.select("row", *key).join(stay.select("all", *key), ["k", "is_null", "version"])
    order = Window.partitionBy("k", "is_null", "version").orderBy(F.xxhash64("row"))
    return met.withColumn("nth", F.row_number().over(order)).where("all OR nth = 1").select("row.*")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, shingles): the full set of each class that shares a bucket, from the text of one of its
    documents (its id and version: null or repeated ids meet no other texts)."""
    # exchanged at every size: a broadcast of the small side at small sizes says nothing of large ones
    d, w = docs.alias("d"), written(wanted, "wanted").hint("merge").alias("w")
    found = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.at_id")) & (F.col("d.version") == F.col("w.at_version"))).select("cid", "c1", "c2", "text")

    last = {"cid": None}

    def one(cols: dict) -> dict:
        hashes = word_hashes()  # of this slice: a worker lives on through later stages and would keep it
        out: dict[str, list] = {"cid": [], "shingles": []}
        for cid, c1, c2, text in zip(cols["cid"], cols["c1"], cols["c2"], cols["text"]):
            if cid == last["cid"]:  # the same row again: the merge join puts repeated rows together
                continue
            last["cid"] = cid
            s = shingle_set(text.encode(), width, hashes)
            if _digest(s) == (c1, c2):
                out["cid"].append(cid)
                out["shingles"].append(s.astype("<u8").tobytes())
        return out

    return written(map_arrow(found, one, "cid bigint, shingles binary"), "sets")
