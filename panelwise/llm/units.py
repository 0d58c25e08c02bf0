"""Substring dedup by units (operator 8): sentences, lines or paragraphs.

Each unit of at least ``min_words`` words is normalised (words joined by one space, A-Z
lowered) and digested.  Digests are grouped over all documents; the occurrence with the
smallest (doc_id, unit number) stays and all others are removed.  Removed spans keep their
offsets in the original text.

A document is a distinct (doc_id, text): repeated rows are one document, each gives the same row.
Null texts are read as empty; an empty text has one empty unit and loses nothing; rows with a
null doc_id rank first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_rows, words_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Where units end.  Every separator is one character long, so offsets add up.
ENDS = {"sentence": r"\n|(?<=[.!?]) ", "line": r"\n", "paragraph": r"\n(?=\n)"}


def split_units(text: str, unit: str) -> list[tuple[int, int]]:
    """(start, end) in characters of each unit, without its separator."""
    out, at = [], 0
    for m in re.finditer(ENDS[unit], text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def unit_digests(df: DataFrame, unit: str, min_words: int) -> DataFrame:
    """doc_id, version, unit, start, end, h1, h2 of the units that count."""
    names = ("doc_id", "version", "unit", "start", "end", "h1", "h2")

    def one(cols: dict) -> dict:
        out: dict[str, list] = {n: [] for n in names}
        for doc, v, text in zip(cols["doc_id"], cols["version"], cols["text"]):
            for k, (a, b) in enumerate(split_units(text, unit)):
                words = words_of(text[a:b].encode())
                if len(words) >= min_words:
                    h = np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16).digest(), "<i8").tolist()
                    for n, x in zip(names, (doc, v, k, a, b, *h)):
                        out[n].append(x)
        return out

    return map_arrow(df, one, "doc_id bigint, version bigint, unit int, start int, end int, h1 bigint, h2 bigint")


def deduplicated(df: DataFrame, unit: str = "sentence", min_words: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_units, n_removed, removed_chars, spans, kept_text of every document."""
    # the digest of the text tells rows apart that share a doc_id
    docs = text_rows(df, id_col, text_col, "doc_id").withColumn("version", F.xxhash64("text"))
    u = unit_digests(docs, unit, min_words)
    place = F.struct(F.col("doc_id"), F.col("version"), F.col("unit"))
    first = u.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # written, so that the join exchanges both sides itself and can split a hot digest
    again = written(first.where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"), "units")
    gone = u.join(again, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    spans = gone.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))  # bounded by the document

    left, right = docs.alias("d"), spans.alias("s")
    both = left.join(right, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.version") == F.col("s.version")), "left")

    def cut(cols: dict) -> dict:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_units", "n_removed", "removed_chars", "spans", "kept_text")}
        for doc, text, gone in zip(cols["doc_id"], cols["text"], cols["gone"]):
            gone = [(g["start"], g["end"]) for g in gone or ()]
            kept, at = [], 0
            for a, b in gone:  # a unit goes with the separator after it
                kept.append(text[at:a])
                at = min(b + 1, len(text))
            kept.append(text[at:])
            row = (doc, len(split_units(text, unit)), len(gone), sum(b - a for a, b in gone),
                   ",".join(f"{a}-{b}" for a, b in gone), "".join(kept))
            for n, x in zip(out, row):
                out[n].append(x)
        return out

    return map_arrow(both.select(F.col("d.doc_id").alias("doc_id"), "text", "gone"), cut,
                     "doc_id bigint, n_units bigint, n_removed bigint, removed_chars bigint, spans string, kept_text string")
