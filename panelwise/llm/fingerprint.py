"""Document fingerprints (operator 13): a homomorphic multiset hash of paragraphs.

A paragraph (a line) hashes to a wide vector: 16 lanes of 64 bits from an extendable-output
digest, and 256 lanes of 16 bits in which each eight-byte window of the paragraph adds +1 or -1 to
one lane.  A fingerprint is the sum of its paragraphs' vectors, modulo 2^64 and 2^16.  Sums do
not depend on order, and paragraphs can be inserted and deleted without reading the others
(``added``, ``removed``).  Equality is that of the multisets of paragraphs, up to collisions of
1,024 bits; how alike two documents are is read off the narrow lanes, whose products estimate
those of the counts of windows (``likeness``, a cosine, error about 1/16).

Null texts are read as empty; an empty text is one empty paragraph.  Repeated rows are
documents of their own, next to each other in the order; rows with a null id come last.  An
empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_nullsafe
from ..plans.ranks import bucket_of
from .common import mix64, text_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDE, NARROW, WINDOW = 16, 256, 8
_LINE = ord("\n")


class Fingerprint:
    """Sums of paragraph vectors."""

    __slots__ = ("wide", "narrow")

    def __init__(self, wide: np.ndarray, narrow: np.ndarray):
        self.wide, self.narrow = wide, narrow

    def hex(self) -> str:
        """Lanes in order, each big-endian, lower-case hex."""
        return self.wide.astype(">u8").tobytes().hex() + self.narrow.astype(">u2").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        data = bytes.fromhex(text)
        return cls(np.frombuffer(data[:8 * WIDE], ">u8").astype(np.uint64), np.frombuffer(data[8 * WIDE:], ">u2").astype(np.uint16))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide + other.wide, self.narrow + other.narrow)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide - other.wide, self.narrow - other.narrow)

    def __eq__(self, other) -> bool:
        return bool((self.wide == other.wide).all() and (self.narrow == other.narrow).all())


def _narrow(data: bytes) -> np.ndarray:
    """Signed counts of the windows inside each line, lane by lane."""
    if len(data) < WINDOW:
        return np.zeros(NARROW, np.uint16)
    window = np.ndarray((len(data) - WINDOW + 1,), "<u8", data, strides=(1,))
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == _LINE)
    if len(breaks):
        inside = np.zeros(len(data) + 1, np.int8)
        inside[breaks] = 1
        seen = np.cumsum(inside, dtype=np.int64)  # line breaks up to here
        before = np.concatenate([[0], seen])
        window = window[before[WINDOW:len(data) + 1] == before[:len(data) - WINDOW + 1]]
    h = mix64(window)
    lane = ((h >> np.uint64(1)) & np.uint64(NARROW - 1)) + (h & np.uint64(1)) * np.uint64(NARROW)
    n = np.bincount(lane.astype(np.int64), minlength=2 * NARROW)
    return (n[:NARROW] - n[NARROW:]).astype(np.int64).astype(np.uint16)


def _wide(paragraphs: list[bytes]) -> np.ndarray:
    digests = b"".join([hashlib.shake_128(p).digest(8 * WIDE) for p in paragraphs])
    return np.frombuffer(digests, "<u8").reshape(len(paragraphs), WIDE).sum(axis=0, dtype=np.uint64)


def fingerprint(paragraphs: Iterable[str]) -> Fingerprint:
    """The sum over paragraphs (none holds a line break)."""
    parts = [p.encode() for p in paragraphs]
    return Fingerprint(_wide(parts) if parts else np.zeros(WIDE, np.uint64), _narrow(b"\n".join(parts)))


def of_text(text: str) -> Fingerprint:
    data = text.encode()
    return Fingerprint(_wide(data.split(b"\n")), _narrow(data))


def added(f: Fingerprint, paragraph: str) -> Fingerprint:
    return f + fingerprint([paragraph])


def removed(f: Fingerprint, paragraph: str) -> Fingerprint:
    return f - fingerprint([paragraph])


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """1 for equal fingerprints; else the cosine of the narrow lanes read as signed counts, at least 0."""
    if a == b:
        return 1.0
    x, y = a.narrow.astype(np.int16).astype(np.float64), b.narrow.astype(np.int16).astype(np.float64)
    size = float((x @ x) * (y @ y)) ** 0.5
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many (or all) of another text."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, the first row of the next range (``border``) at its end: each row
    meets the one after it, also across batches."""
    held = None
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                                "near_edited", "near_next")}
        for part, border, doc, text in zip(*(batch.column(n).to_pylist() for n in ("part", "border", "doc_id", "text"))):
            if held is not None and held[0] != part:
                held = None  # the range before has had its border row
            if border and held is None:
                continue
            mark = of_text(text)
            if held is not None:
                _, last, last_text, last_mark = held
                new = edited(last_text, text)
                new_mark = of_text(new)
                for name, value in zip(out, (last, len(last_text), hashlib.sha256(new.encode()).hexdigest(), last_mark.hex(),
                                             new_mark.hex(), likeness(last_mark, new_mark), likeness(last_mark, mark))):
                    out[name].append(value)
            held = None if border else (part, doc, text, mark)
        types = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every
    document against the next one in descending order of ids (after the last: the first).

    Ids are cut into ranges at bounds from a bounded sample; the first row of each range (one a
    range) is also sent to the range before it, so texts cross the network once."""
    rows = text_rows(df, id_col, text_col, "doc_id").withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("part", bucket_of(rows, ["doc_id", "tie"], parts).cast("int"))
    first = rows.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("m")).collect()  # one row a range
    first = sorted(((r["part"], r["m"]["doc_id"], r["m"]["tie"]) for r in first), reverse=True)
    id_type = df.schema[id_col].dataType.simpleString()
    before = [(*r, first[i - 1][0]) for i, r in enumerate(first)]  # the range that precedes it in descending order
    marks = df.sparkSession.createDataFrame(before, f"part int, doc_id {id_type}, tie bigint, to int")
    copies = join_nullsafe(rows, F.broadcast(marks), ["part", "doc_id", "tie"]).select(
        F.col("to").alias("part"), F.lit(True).alias("border"), "doc_id", "tie", "text")
    whole = rows.select("part", F.lit(False).alias("border"), "doc_id", "tie", "text").unionByName(copies)
    order = ["part", "border", F.col("doc_id").desc(), F.col("tie").desc()]
    return whole.repartition("part").sortWithinPartitions(*order).mapInArrow(
        _compare, f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                  "near_edited double, near_next double")
