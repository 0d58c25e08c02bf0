"""Suffix-array dedup (operator 10): bytes inside any ``length``-byte string that also starts
somewhere else.

Sorting every suffix of a corpus is not needed, and per-shard arrays that are searched against
each other grow with the square of the shards.  So shards are made by *content*:

1. Every window of ``length`` bytes is assigned to its minimizer, the ``GRAM``-byte string in it
   with the smallest digest (the leftmost of equals).  Equal windows have equal minimizers, so
   they meet wherever they are.  Neighbouring windows with one minimizer form a *context*.
2. Minimizers that occur once are dropped.  Contexts that are equal byte for byte (digest of
   64 bits besides the minimizer's 64) are duplicates throughout, and one of them stands for
   all; most of a group of copies is settled here, by counting.
3. Different contexts of one minimizer go to a shard.  Each shard builds a suffix array with
   Larsson-Sadakane refinement (ranks by doubling, only groups that are still equal are sorted
   again) and common prefixes with Kasai's algorithm, run in step over all contexts.  Windows
   whose neighbours share ``length`` bytes are duplicates.
4. A minimizer with very many different contexts is dealt over several shards.  Each of these
   emits one digest for each class of equal windows; the digests are exchanged and merged in
   sorted order, so that copies in different shards find each other.  (Searching each shard's
   array from each other shard would grow with the square of their number.)

Windows never reach over documents; strings are judged on the input.  Null texts are read as
empty; texts shorter than ``length`` lose nothing; repeated rows are copies of each other (equal
rows get equal results); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix64, text_rows, written
from .minhash import grouped

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of the strings that are minimizers.
GRAM = 24
#: Bytes handled at once, and bits of a position in them.
SLAB, SLAB_BITS = 1 << 20, 21
#: Contexts of one suffix array (about 300 bytes each).  A minimizer with more has a shard of its
#: own, and one with over four times as many is dealt over several.
SHARD = 2_048


# ---- minimizers --------------------------------------------------------------------------

def _grams(buf: bytes) -> np.ndarray:
    """A 64-bit digest of each GRAM-byte string."""
    n = len(buf) - GRAM + 1
    word = lambda at: np.ndarray((n,), "<u8", buf, at, (1,))
    x = word(0) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) + word(8)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) + word(16)
    return mix64(x)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    pad = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def contexts(buf: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Contexts of pieces laid end to end (``ends``: where each ends): piece, first and last
    window start, digest of the minimizer."""
    grams = _grams(buf)
    mask = np.uint64((1 << SLAB_BITS) - 1)
    best = _window_min((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    at = (best & mask).astype(np.int64)
    start = np.arange(len(at))
    piece = np.searchsorted(ends, start, side="right")
    valid = start + length <= ends[piece]
    new = np.flatnonzero(valid & np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | ~valid[:-1]]))
    stop = np.flatnonzero(valid & np.concatenate([(at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | ~valid[1:], [True]]))
    return piece[new], new, stop, grams[at[new]]


def _slabs(docs: list[bytes], length: int):
    """(bytes, ends, document of each piece, offset of each piece): documents laid end to end,
    long ones in parts that overlap by ``length`` - 1."""
    buf, ends, owner, offset, size = [], [], [], [], 0
    for i, d in enumerate(docs):
        for a in range(0, max(0, len(d) - length + 1), SLAB):
            part = d[a:a + SLAB + length - 1]
            if size and size + len(part) > SLAB + length - 1:
                yield b"".join(buf), np.array(ends), owner, offset
                buf, ends, owner, offset, size = [], [], [], [], 0
            size += len(part)
            buf.append(part)
            ends.append(size)
            owner.append(i)
            offset.append(a)
    if size:
        yield b"".join(buf), np.array(ends), owner, offset


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, in order; touching ones are joined."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, top = start[o], np.maximum.accumulate(end[o])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > top[:-1]]))
    return start[new], top[np.concatenate([new[1:] - 1, [len(top) - 1]])]


def gram_counts(docs: DataFrame, length: int) -> DataFrame:
    """(gram, n): contexts of each minimizer, added up for each slab of text."""
    def run(batches):
        for b in batches:
            for buf, ends, _, _ in _slabs([t.as_py().encode() for t in b.column(0)], length):
                gram, n = np.unique(contexts(buf, ends, length)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n)], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def context_rows(docs: DataFrame, length: int) -> DataFrame:
    """One row for each different context of a document (gram, digest, copies 1 or 2, first and
    last window start), and one (gram null) for each span that repeats inside it."""
    names = ["doc_id", "version", "gram", "digest", "copies", "first", "last"]

    def run(batches):
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            raw = [t.as_py().encode() for t in batch.column(2)]
            for buf, ends, owner, offset in _slabs(raw, length):
                piece, a, b, gram = contexts(buf, ends, length)
                digest = np.array([xxhash.xxh3_64_intdigest(buf[x:y]) for x, y in zip(a.tolist(), (b + length).tolist())], np.uint64)
                doc = np.array(owner)[piece]
                shift = np.array(offset)[piece] - np.concatenate([[0], ends[:-1]])[piece]
                a, b = a + shift, b + shift
                o = np.lexsort((digest, gram, doc))
                same = (doc[o][1:] == doc[o][:-1]) & (gram[o][1:] == gram[o][:-1]) & (digest[o][1:] == digest[o][:-1])
                head = np.concatenate([[True], ~same])
                many = np.concatenate([same, [False]]) | ~head
                pick = o[head]
                at = pa.array(doc[pick])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), versions.take(at), *(pa.array(x.astype(np.int64)) for x in (
                        gram[pick], digest[pick], 1 + many[head], a[pick], b[pick]))], names=names)
                rep = o[many]
                for i in np.unique(doc[rep]).tolist():
                    mine = rep[doc[rep] == i]
                    x, y = merged(a[mine], b[mine] + length)
                    at, none = pa.array(np.full(len(x), i)), pa.nulls(len(x), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), versions.take(at), none, none, none, pa.array(x), pa.array(y - length)], names=names)

    return docs.select("doc_id", "version", "text").mapInArrow(
        run, "doc_id bigint, version bigint, gram bigint, digest bigint, copies bigint, first bigint, last bigint")


# ---- suffix arrays -----------------------------------------------------------------------

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by Larsson-Sadakane refinement: suffixes are ranked by their first 8 bytes,
    then by twice as many with each round; only groups that are still equal are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).tobytes()
    word = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    sa = np.argsort(word).astype(np.int32)
    heads = np.concatenate([[True], word[sa][1:] != word[sa][:-1]])
    slot = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(heads, slot, 0))
    h = 8
    while h < 2 * n:
        last = np.concatenate([heads[1:], [True]])
        open_ = np.flatnonzero(~(heads & last))
        if not len(open_):
            break
        at = sa[open_]
        ahead = at.astype(np.int64) + h
        key = (rank[at].astype(np.int64) << 32) | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        o = np.argsort(key)
        sa[open_], key = at[o], key[o]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        heads[open_] = new
        rank[sa[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2
    return sa


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading equal bytes (0 .. 8) of little-endian words, from their exclusive or."""
    low = x & (~x + np.uint64(1))
    return np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cap: int) -> np.ndarray:
    """Bytes (at most ``cap``) that each suffix shares with the one before it in the array.

    Kasai: going from one position to the next, at most one byte of the common prefix is
    lost.  All stretches (``starts``, ``sizes``) are walked in step, eight bytes at a time."""
    n = len(text)
    word = np.ndarray((n + cap,), "<u8", np.concatenate([text, np.zeros(cap + 8, np.uint8)]).tobytes(), 0, (1,)).astype(np.uint64)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    o = np.argsort(-sizes)
    starts, sizes = starts[o], sizes[o]
    held = np.zeros(len(starts), np.int64)
    alive = len(starts)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        while sizes[alive - 1] <= t:
            alive -= 1
        p = starts[:alive] + t
        q = before[p].astype(np.int64)
        k = np.where(q >= 0, np.maximum(held[:alive] - 1, 0), 0)
        most = np.where(q >= 0, np.minimum(cap, n - np.maximum(p, q)), 0)
        go = np.flatnonzero(k < most)
        while len(go):
            same = _equal_bytes(word[p[go] + k[go]] ^ word[q[go] + k[go]])
            k[go] += same
            go = go[(same == 8) & (k[go] < most[go])]
        np.minimum(k, most, out=k)
        held[:alive] = k
        out[p] = k
    return out


def repeated_windows(parts: list[bytes], copies: list[int], length: int, classes: bool = True
                     ) -> tuple[list[np.ndarray], list[tuple[int, int, bool]]]:
    """For each context (its bytes; the last ``length`` - 1 start no window), which of its windows
    also start elsewhere; and, if asked for, (context, window, single) of one window of each class."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, starts, sizes, length)[sa]
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    inside = np.arange(len(text), dtype=np.int32) - starts.astype(np.int32)[owner]
    weight = np.where(inside + length <= sizes[owner], np.array(copies, np.int8)[owner], 0)[sa]
    cls = np.cumsum(lcp < length, dtype=np.int32) - 1
    total = np.bincount(cls, weights=weight)
    hit = np.zeros(len(text), bool)
    hit[sa] = (total[cls] > 1) & (weight > 0)
    reps = np.flatnonzero(weight > 0) if classes else np.empty(0, np.int64)
    reps = reps[np.unique(cls[reps], return_index=True)[1]]
    found = [(int(owner[sa[i]]), int(inside[sa[i]]), bool(total[cls[i]] == 1)) for i in reps]
    return [np.flatnonzero(hit[s:s + m]) for s, m in zip(starts.tolist(), sizes.tolist())], found


def _shard_spans(work: DataFrame, length: int) -> DataFrame:
    """Spans (first, end) of duplicate windows in shards; rows with d1 set are window classes of
    minimizers that are dealt over several shards."""
    names = ("doc_id", "version", "first", "end", "d1", "d2")
    types = [pa.int64()] * 6

    def run(batches):
        for rows in grouped(batches, ["shard", "salt"]):
            out: dict[str, list] = {n: [] for n in names}
            parts = [r["bytes"] for r in rows]
            hits, classes = repeated_windows(parts, [r["copies"] for r in rows], length, rows[0]["salt"] >= 0)
            for r, w in zip(rows, hits):
                if len(w) and r["copies"] == 1:  # the others are settled
                    for a, b in zip(*(v.tolist() for v in merged(w, w + length))):
                        for n, v in zip(names, (r["doc_id"], r["version"], r["first"] + a, r["first"] + b, None, None)):
                            out[n].append(v)
            if rows[0]["salt"] >= 0:
                for i, w, single in classes:
                    r = rows[i]
                    d = np.frombuffer(hashlib.blake2b(parts[i][w:w + length], digest_size=16).digest(), "<i8").tolist()
                    at = r["first"] + w if single else None
                    for n, v in zip(names, (r["doc_id"], r["version"], at, None, *d)):
                        out[n].append(v)
            if out["doc_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], names=list(names))

    return (work.repartition("shard", "salt").sortWithinPartitions("shard", "salt")
            .mapInArrow(run, "doc_id bigint, version bigint, first bigint, end bigint, d1 bigint, d2 bigint"))


def _met_elsewhere(classes: DataFrame, length: int) -> DataFrame:
    """Spans of single windows whose digest another shard has too."""
    def run(batches):
        for rows in grouped(batches, ["d1", "d2"]):  # one row for each shard at most
            if len(rows) > 1:
                got = [r for r in rows if r["first"] is not None]
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[c] for r in got], pa.int64()) for c in ("doc_id", "version", "first")]
                        + [pa.array([r["first"] + length for r in got], pa.int64())], names=["doc_id", "version", "first", "end"])

    return (classes.select("doc_id", "version", "first", "d1", "d2").repartition("d1", "d2").sortWithinPartitions("d1", "d2")
            .mapInArrow(run, "doc_id bigint, version bigint, first bigint, end bigint"))


# ---- the operator ------------------------------------------------------------------------

def duplicate_spans(docs: DataFrame, length: int, shard: int = SHARD) -> DataFrame:
    """doc_id, version, first, end: spans to remove, in bytes; they may overlap."""
    rows = context_rows(docs, length)
    grams = gram_counts(docs, length).where("n > 1").select("gram")
    local = rows.where("gram is null")
    near = written(rows.join(written(grams, "grams"), "gram").select("doc_id", "version", "gram", "digest", "copies", "first", "last"), "near")
    kinds = written(near.groupBy("gram", "digest").agg(
        F.sum("copies").alias("n"), F.min(F.struct("doc_id", "version", "first", "last")).alias("at")), "kinds")
    whole = near.join(kinds.where("n > 1").select("gram", "digest"), ["gram", "digest"])
    spans = [local.select("doc_id", "version", "first", (F.col("last") + length).alias("end")),
             whole.select("doc_id", "version", "first", (F.col("last") + length).alias("end"))]

    mixed = written(kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
                    .where("kinds > 1 and single > 0").select("gram", "kinds"), "mixed")
    total = kinds.join(mixed, "gram")
    shards = max(1, -(-(mixed.where(F.col("kinds") <= shard).agg(F.sum("kinds")).first()[0] or 0) // shard))
    salts = F.ceil(F.col("kinds") / (4 * shard))
    want = total.select(F.col("at.doc_id").alias("doc_id"), F.col("at.version").alias("version"), F.struct(
        F.when(F.col("kinds") > shard, F.col("gram")).otherwise(F.pmod(F.xxhash64("gram"), F.lit(shards))).alias("shard"),
        F.when(salts > 1, F.pmod(F.xxhash64("digest"), salts)).when(F.col("kinds") > shard, F.lit(-2))
        .otherwise(F.lit(-1)).cast("long").alias("salt"),
        F.least("n", F.lit(2)).alias("copies"), F.col("at.first").alias("first"), F.col("at.last").alias("last")).alias("c"))
    per_doc = written(want.groupBy("doc_id", "version").agg(F.collect_list("c").alias("cs")), "wanted")  # bounded by the document

    seen = set()

    def cut(cols: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "version", "shard", "salt", "copies", "first", "bytes")}
        for doc, v, cs, text in zip(cols["doc_id"], cols["version"], cols["cs"], cols["text"]):
            if (doc, v) in seen:  # a repeated row holds the same bytes: once a task
                continue
            seen.add((doc, v))
            raw = text.encode()
            for c in cs:
                for n, x in zip(out, (doc, v, c["shard"], c["salt"], c["copies"], c["first"], raw[c["first"]:c["last"] + length])):
                    out[n].append(x)
        return out

    texts = docs.join(per_doc.withColumnRenamed("doc_id", "i").withColumnRenamed("version", "v"),
                      F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")))
    work = map_arrow(texts.select("doc_id", "version", "cs", "text"), cut,
                     "doc_id bigint, version bigint, shard bigint, salt bigint, copies bigint, first bigint, bytes binary")
    found = written(_shard_spans(work, length), "shards")
    spans.append(found.where("d1 is null").select("doc_id", "version", "first", "end"))
    spans.append(_met_elsewhere(found.where("d1 is not null"), length))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def cut_spans(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """doc_id, version, text, starts, ends of every row: merged spans of bytes to remove."""
    docs = text_rows(df, id_col, text_col, "doc_id").withColumn("version", F.xxhash64("text"))
    spans = duplicate_spans(docs, length, shard).groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("first", "end")).alias("spans"))  # bounded by the document: repeated rows have equal spans
    both = docs.join(spans.withColumnRenamed("doc_id", "i").withColumnRenamed("version", "v"),
                     F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")), "left")
    return both.select("doc_id", "version", "text", "spans")


def kept_bytes(raw: bytes, spans) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, number of removed runs)."""
    if not spans:
        return raw, 0, 0
    a, b = merged(np.array([s["first"] for s in spans]), np.array([s["end"] for s in spans]))
    cut = np.concatenate([[0], np.column_stack([a, b]).ravel(), [len(raw)]]).tolist()
    return b"".join(raw[x:y] for x, y in zip(cut[::2], cut[1::2])), int((b - a).sum()), len(a)


def without_repeats(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row."""
    def one(cols: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "version", "n_bytes", "n_removed", "n_spans", "kept")}
        for doc, v, text, spans in zip(cols["doc_id"], cols["version"], cols["text"], cols["spans"]):
            raw = text.encode()
            kept, removed, runs = kept_bytes(raw, spans)
            for n, x in zip(out, (doc, v, len(raw), removed, runs, kept)):
                out[n].append(x)
        return out

    return map_arrow(cut_spans(df, length, id_col, text_col, shard), one,
                     "doc_id bigint, version bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def replaced(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
             shard: int = SHARD) -> DataFrame:
    """The rows of ``df``, all columns, with the repeated bytes taken out of the text (and its
    length in characters brought up to date).  Bytes of a character that was cut go with it."""
    docs = text_rows(df, id_col, text_col, "doc_id").withColumn("version", F.xxhash64("text"))
    spans = duplicate_spans(docs, length, shard).groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("first", "end")).alias("spans"))  # bounded by the document: repeated rows have equal spans
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                     F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("version"))
    both = rows.join(spans.withColumnRenamed("doc_id", "i").withColumnRenamed("version", "v"),
                     F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")), "left").select("row", "spans")
    columns = df.columns

    def run(batches):
        for b in batches:
            row, spans = b.column(0), b.column(1).to_pylist()
            text = row.field(text_col).to_pylist()
            size = row.field(chars_col).to_pylist() if chars_col in columns else []
            for i, s in enumerate(spans):
                if s:
                    text[i] = kept_bytes(text[i].encode(), s)[0].decode("utf-8", "ignore")
                    if size:
                        size[i] = len(text[i])
            new = {text_col: text, **({chars_col: size} if size else {})}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], row.field(c).type) if c in new else row.field(c) for c in columns], names=columns)

    return both.mapInArrow(run, df.schema)
