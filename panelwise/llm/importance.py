"""Target-distribution importance resampling (operator 11): hashed n-gram gains and a Gumbel draw.

A text is lower-cased (A-Z), its separators are collapsed to single spaces, and one overlapped
scan of a regular expression with lookarounds at the word borders gives, for each word, the
spans of the one to three words that start there.  The CRC of each span is its feature.

Texts are scanned once: a document's buckets are written as 16-bit numbers (32-bit above 65,536
buckets), and corpus totals, weights and scores are read from that table.  Gains are one number
a bucket.  The draw takes exact ranks over all scored documents by ranges, not in one task.

Null texts are read as empty (no features, weight 0); a null id draws as the empty string.
Repeated rows are documents of their own and are ranked one after another.  Without documents
the result is empty; without target texts every count of theirs is zero.  Extra input columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import sys
import zlib

import numpy as np
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import running_totals
from .common import map_arrow, text_rows, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words are ASCII letters and digits and all bytes of other characters; the rest separates.
_FLAT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_GAPS = regex.compile(rb"  +")


def span_pattern(longest: int):
    """One match at each word, at the space before it; groups: the word and up to ``longest - 1``
    following ones, each with the space before it."""
    return regex.compile(rb" (?=([^ ]++)" + rb"( [^ ]++)?" * (longest - 1) + rb")")


def flat_words(text: str) -> bytes:
    """Lower-case words of a text, one space between two."""
    return _GAPS.sub(b" ", text.encode().translate(_FLAT)).strip(b" ")


def buckets_of(text: str, pattern, n_buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of words that the pattern gives: the CRC of a
    run goes on from that of the run before it."""
    crc32, out, n = zlib.crc32, [], 0
    add = out.append
    for m in pattern.finditer(b" " + flat_words(text), overlapped=True):
        n += 1
        crc = 0
        for word in m.groups():
            if word is None:
                break
            crc = crc32(word, crc)
            add(crc)
    return n, np.array(out, np.uint32) % np.uint32(n_buckets)


def scanned(df: DataFrame, id_col: str, text_col: str, n_buckets: int, longest: int) -> DataFrame:
    """id, n_words, n_features, body: the buckets of all features of every whole text."""
    pattern, kind = span_pattern(longest), "<u2" if n_buckets <= 65_536 else "<u4"

    def one(cols: dict) -> dict:
        rows = [buckets_of(t, pattern, n_buckets) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_words": [n for n, _ in rows], "n_features": [len(b) for _, b in rows],
                "body": [b.astype(kind).tobytes() for _, b in rows]}

    id_type = df.schema[id_col].dataType.simpleString()
    return map_arrow(text_rows(df, id_col, text_col, "doc_id"), one,
                     f"doc_id {id_type}, n_words bigint, n_features bigint, body binary")


def totals(rows: DataFrame, n_buckets: int) -> np.ndarray:
    """Features in each bucket: counted in each slice, summed in Spark; one number a bucket returns."""
    kind = "<u2" if n_buckets <= 65_536 else "<u4"

    def count(cols: dict) -> dict:
        n = np.bincount(np.frombuffer(b"".join(cols["body"]), kind), minlength=n_buckets)
        at = np.flatnonzero(n)
        return {"bucket": at, "n": n[at]}

    sums = map_arrow(rows.select("body"), count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in sums.collect():  # at most n_buckets rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ((t + 1) (S + n) / ((s + 1) (T + n)))) of each bucket, in doubles."""
    n, big_s, big_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + n) / ((s + 1.0) * (big_t + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id, seed: int) -> int:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
              n_buckets: int = 10_000, longest: int = 3, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """id, n_features, weight, score, rank: ``percent`` of the documents with at least ``least_words``
    words are drawn, those with the highest scores (ties: the smaller id); others have no rank."""
    rows = written(scanned(df, id_col, text_col, n_buckets, longest), "features")
    wanted = scanned(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), "id", "text", n_buckets, longest)
    gain = gains(totals(rows, n_buckets), totals(wanted, n_buckets))
    kind = "<u2" if n_buckets <= 65_536 else "<u4"

    def score(cols: dict) -> dict:
        weight = [int(gain[np.frombuffer(b, kind)].sum()) for b in cols["body"]]
        return {"doc_id": cols["doc_id"], "n_words": cols["n_words"], "n_features": cols["n_features"], "weight": weight,
                "score": [w + gumbel(d, seed) for w, d in zip(weight, cols["doc_id"])]}

    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = written(map_arrow(rows, score, f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint, score bigint"), "scores")
    open_ = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    n_drawn = percent * scored.where(open_).count() // 100
    order = ["_down", "doc_id", "n_features"]
    ranked = running_totals(scored.where(open_).withColumn("_down", -F.col("score")), order, {"_rank": F.lit(1)})
    rank = F.when(F.col("_rank") <= n_drawn, F.col("_rank")).cast("bigint").alias("rank")
    cols = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*cols, rank).unionByName(scored.where(~open_).select(*cols, F.lit(None).cast("bigint").alias("rank")))
