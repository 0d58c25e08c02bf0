"""Byte-level BPE encoding and decoding (operator 1) with the tiktoken library.

The vocabulary is a local rank file.  Long texts are cut before encoding at places where the
splitting pattern always separates, so memory and time per call stay bounded and the ids are
those of the whole text.  Ids decode to raw bytes (no replacement characters).

Null texts are read as empty; an empty text has no ids; repeated rows give equal rows; an
empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from typing import Iterator

import numpy as np
import regex
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import map_arrow, process_cache, text_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A letter (digit) is never in one match with a following non-letter (non-digit), and ASCII
#: punctuation never with a following space: the text may be cut between the two characters.
_SAFE = r"[A-Za-z0-9.,;:!?)][ \n]|\p{L}\P{L}|\p{N}\P{N}"


#: A run of white space this long is handed over as the one match that it is: the library's
#: expression engine keeps a stack entry for each of its characters.
_LONG_SPACE = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, built once a worker."""
    cache, key = process_cache(), ("tiktoken", path, pattern)
    if key not in cache:
        cache[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return cache[key]


def safe_parts(text: str, size: int = 65_536) -> Iterator[str]:
    """Slices of about ``size`` characters, cut only where the pattern always separates."""
    if len(text) <= size:
        yield text
        return
    safe, start = regex.compile(_SAFE), 0
    while len(text) - start > size:
        m = safe.search(text, start + size)
        if m is None:
            break
        yield text[start:m.start() + 1]
        start = m.start() + 1
    yield text[start:]


def matches_apart(text: str) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match): long runs of white space stand alone.  The pattern
    leaves a run's last character to what follows, and takes the whole run at the end."""
    at = 0
    if len(text) > _LONG_SPACE:
        for m in regex.finditer(r"\s{%d,}" % _LONG_SPACE, text):
            end = m.end() - (m.end() < len(text))
            yield text[at:m.start()], False
            yield text[m.start():end], True
            at = end
    yield text[at:], False


def encode(text: str, enc: tiktoken.Encoding, whole: tiktoken.Encoding | None = None) -> np.ndarray:
    """Ids of a whole text, little-endian unsigned 32-bit.  ``whole`` has the same ranks and
    takes any text as one match."""
    out = [np.empty(0, "<u4")]
    for part, single in matches_apart(text):
        if single:
            out.append((whole or _one_match(enc)).encode_to_numpy(part))
        else:
            out += [enc.encode_to_numpy(p) for p in safe_parts(part)]
    return np.concatenate(out).astype("<u4")


def _one_match(enc: tiktoken.Encoding) -> tiktoken.Encoding:
    return tiktoken.Encoding("one match", pat_str=r"(?s:.+)", mergeable_ranks=enc._mergeable_ranks, special_tokens={})


def decode(ids: np.ndarray, enc: tiktoken.Encoding, size: int = 65_536) -> Iterator[bytes]:
    """Raw bytes of the ids, in slices."""
    for i in range(0, len(ids), size):
        yield enc.decode_bytes(ids[i:i + size].tolist())


def encoded(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text as an array."""
    def one(cols: dict) -> dict:
        enc = encoding(path, pattern)
        return {id_col: cols[id_col], "ids": [encode(t, enc).astype(np.int32) for t in cols["text"]]}

    return map_arrow(text_rows(df, id_col, text_col, id_col), one, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decoded(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the raw bytes of an array of ids (null: empty)."""
    def one(cols: dict) -> dict:
        enc = encoding(path, pattern)
        return {id_col: cols[id_col], "bytes": [b"".join(decode(np.asarray(x or [], "<u4"), enc)) for x in cols[ids_col]]}

    return map_arrow(df.select(id_col, ids_col), one, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest every whole text: ids are digested as little-endian unsigned
    32-bit integers, the decoded bytes as they are."""
    def one(cols: dict) -> dict:
        enc = encoding(path, pattern)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in cols["text"]:
            ids, back = encode(text, enc), hashlib.sha256()
            for part in decode(ids, enc):
                back.update(part)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(back.hexdigest())
        return out

    return map_arrow(text_rows(df, id_col, text_col, "doc_id"), one,
                     "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
