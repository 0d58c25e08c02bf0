"""Texts as sequences of repeated chunks, cut at spaces where tokenizers always separate.

Words repeat, so work on words is done once for each distinct chunk of a batch: Arrow splits
the texts and numbers the distinct chunks, and numpy carries results back to the texts.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space of any kind (fixed values: Unicode White_Space and the ASCII separators).
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space at an end of the text, beside another space, or between other white space.
_UNCLEAR = rf"\A | \z|  |{_WHITE} {_WHITE}"


def chunked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(bounds, codes, distinct): text i is ``" ".join(distinct[c] for c in codes[bounds[i]:bounds[i + 1]])``.

    Cuts are at single spaces.  A space that stands beside another one stays inside its chunk,
    so splitting patterns that give a run's last space to the next word (and vocabularies whose
    pieces hold runs of spaces) see the run whole.  An empty text is one empty chunk."""
    unclear = pc.match_substring_regex(texts, _UNCLEAR)
    at = np.flatnonzero(unclear.to_numpy(zero_copy_only=False))
    if len(at) == 0:
        lists = pc.split_pattern(texts, " ")
    else:
        clear = pc.split_pattern(pc.if_else(unclear, pa.scalar("", texts.type), texts), " ")
        cut = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
        others = pa.array([cut.split(t) for t in texts.take(pa.array(at)).to_pylist()], clear.type)
        take = np.arange(len(texts))
        take[at] = len(texts) + np.arange(len(at))
        lists = pa.concat_arrays([clear, others]).take(pa.array(take))
    bounds, codes, words = _numbered(lists)
    return bounds, codes, words.to_pylist()


def split_at_spaces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(bounds, codes, distinct) as above, the distinct chunks as an Arrow array, cut at every
    space and line feed, for tokenizers that drop white space.  Chunks may be empty."""
    return _numbered(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))


def _numbered(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    words = lists.flatten().dictionary_encode()
    bounds = np.asarray(lists.offsets).astype(np.int64)
    return bounds - bounds[0], words.indices.to_numpy(), words.dictionary


def strings(values: pa.Array) -> list[str]:
    """``to_pylist`` of an Arrow array of strings without nulls, several times as fast."""
    return values.to_numpy(zero_copy_only=False).tolist()


def joined(values: pa.LargeBinaryArray, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """Entry i is ``values[bounds[i]:bounds[i + 1]]`` one after another; no bytes are moved."""
    if len(values) == 0:
        return pa.array([b""] * (len(bounds) - 1), values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:][bounds]
    return pa.Array.from_buffers(values.type, len(bounds) - 1, [None, pa.py_buffer(offsets), values.buffers()[2]])


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for every i."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def slices_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + sizes[i] - 1`` of all i, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct integers in order."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values
