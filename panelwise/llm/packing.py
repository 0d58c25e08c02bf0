"""Best-fit packing (operator 2): token pieces into as few sequences as possible.

Large-item matching: of pieces above one third of the capacity at most two share a sequence,
so they are paired greedily, the longest with the longest that still fits.  Smaller pieces
then go, longest first, into the fullest sequence that still has room for them.

Equal lengths are interchangeable, so the plan is made on the *histogram of lengths* (at most
``capacity`` entries, whatever the number of documents) and says which ranks of each length go
to which sequences.  The documents themselves never leave their tasks: each piece gets its
rank among equal lengths from a salted window and looks its place up in the plan.

Null texts are read as empty (the end id alone); repeated rows are packed once each; an empty
table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import joined, split_at_spaces, strings
from .common import BoundedMemo, map_batches, process_cache, text_rows, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- token ids ---------------------------------------------------------------------------

#: Not plain: a character past Latin-1, or what a special string starts with.
_HARD = r"<\||[^\x00-\x{ff}]"
_LETTERS = r"^\p{L}+$"


class ChunkIds:
    """Ids of whole texts by a ``tokenizers`` file that splits at white space and drops it.

    A text is the sequence of its chunks between single ASCII spaces and line feeds, and each
    chunk is encoded on its own: white space separates words whatever stands beside it, and
    neither normal forms, lower case nor special strings reach over it.  Latin-1 chunks without
    ``<|`` are split further, by the file's own expression, into lower-case words (Latin-1 text is
    in normal form, and its lower case is letter by letter); a chunk of letters is one word, where
    the expression says so.
    Distinct chunks and words of a batch are numbered once, and Arrow carries ids from words to
    chunks to texts.  Ids are kept in a bounded table; words first seen go to the library's model,
    many in one text, and are told apart by the ids that end a word.  They are lower-case and cut
    already, so the model gets them by a copy of the file that only splits at white space."""

    def __init__(self, path: str, limit: int = 400_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.words = regex.compile(rf"\n|{pattern}").findall  # (a word holds no white space)
        letters = "".join(c for c in map(chr, range(256)) if c.isalpha()).lower()
        self.letters_whole = self.words(letters) == [letters]
        end, vocab = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if end and t.endswith(end)]] = True
        self.tokenizer, self.longest = Tokenizer.from_file(path), longest
        spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"] = None, [
            {"type": "WhitespaceSplit"} if s["type"] == "Split" else s for s in steps]
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.word_ids = BoundedMemo(None, limit, longest)

    def _library(self, texts: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _words(self, words: list[str], size: int = 256) -> list[bytes]:
        """Ids of single words."""
        out = []
        groups = [words[i:i + size] for i in range(0, len(words), size)]
        for group, raw in zip(groups, self._library([" ".join(g) for g in groups], self.model)):
            ids = np.frombuffer(raw, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1)).tolist()
            if len(cut) == len(group) and cut[-1] == len(raw):
                out += [raw[a:b] for a, b in zip([0, *cut], cut)]
            else:
                out += self._library(group)
        return out

    def _known(self, keys: list[str], encode) -> pa.LargeBinaryArray:
        """Ids of each key, from the table or by ``encode``."""
        out, new = list(map(self.word_ids.get, keys)), []
        for i in [i for i, v in enumerate(out) if v is None]:
            out[i] = self.word_ids.known(keys[i])  # (it may lie in the older half)
            if out[i] is None:
                new.append(i)
        for i, v in zip(new, encode([keys[i] for i in new])):
            out[i] = v
            self.word_ids.keep(keys[i], v)
        return pa.array(out, pa.large_binary())

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        bounds, codes, chunks = split_at_spaces(texts)
        short = pc.less_equal(pc.utf8_length(chunks), self.longest).to_numpy(zero_copy_only=False)
        hard, letters = (pc.match_substring_regex(chunks, e).to_numpy(zero_copy_only=False) for e in (_HARD, _LETTERS))
        plain, letters = short & ~hard, letters & self.letters_whole
        groups = [np.flatnonzero(m) for m in (plain & letters, plain & ~letters, ~plain)]
        whole, mixed, others = (chunks.take(pa.array(g)) for g in groups)
        # words of mixed chunks, each chunk closed by a line feed
        found = pa.array(self.words("".join([c + "\n" for c in strings(mixed)]).lower()), chunks.type)
        closing = pc.equal(found, "\n")
        closed = np.flatnonzero(closing.to_numpy(zero_copy_only=False)) - np.arange(len(mixed))
        words = pa.concat_arrays([pc.utf8_lower(whole), found.filter(pc.invert(closing))]).dictionary_encode()
        # words -> chunks -> texts
        ids = self._known(strings(words.dictionary), self._words).take(words.indices)
        by_chunk = joined(ids, np.concatenate([np.arange(len(whole) + 1), len(whole) + closed]))
        by_chunk = pa.concat_arrays([by_chunk, self._known(strings(others), self._library)])
        at = np.empty(len(chunks), np.int64)
        at[np.concatenate(groups)] = np.arange(len(chunks))
        return joined(by_chunk.take(pa.array(at[codes])), bounds).to_pylist()


def _chunk_ids(path: str) -> ChunkIds:
    cache, key = process_cache(), ("chunk_ids", path)
    if key not in cache:
        cache[key] = ChunkIds(path)
    return cache[key]


def pieces(df: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every whole text followed by ``end_id``; only longer ones are cut."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc, ids in zip(batch.column("doc_id").to_pylist(), _chunk_ids(path).encode(batch.column("text"))):
            ids += end
            for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[i:i + 4 * capacity]
                for name, v in zip(out, (doc, k, i // 4, len(part) // 4, zlib.crc32(part))):
                    out[name].append(v)
        return out

    return map_batches(text_rows(df, id_col, text_col, "doc_id"), cut,
                       "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---- the plan ----------------------------------------------------------------------------

class Plan:
    """Where the r-th piece of each length goes: runs of (length, first rank, first sequence,
    offset), ordered by length and rank."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int]] = []
        self.gaps: list[int] = []  # sorted free sizes, each with its runs of sequences
        self.free: dict[int, list[tuple[int, int]]] = {}
        self._match_large()
        for n in sorted((n for n in self.left if 3 * n <= capacity), reverse=True):
            self._fit_small(n)
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 4)
        self.key = (runs[:, 0] << 44) | runs[:, 1]
        self.first, self.offset, self.run_rank = runs[:, 2].copy(), runs[:, 3].copy(), runs[:, 1].copy()

    def _place(self, n: int, count: int, first: int, offset: int) -> None:
        self.runs.append((n, self.rank[n], first, offset))
        self.rank[n] += count
        self.left[n] -= count

    def _open(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def _add_gap(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.free:
                self.free[gap] = []
                bisect.insort(self.gaps, gap)
            self.free[gap].append((first, count))

    def _match_large(self) -> None:
        cap = self.capacity
        large = sorted(n for n in self.left if 3 * n > cap)
        while large:
            a = large[-1]
            if not self.left[a]:
                large.pop()
                continue
            i = bisect.bisect_right(large, cap - a) - 1
            while i >= 0 and not (self.left[large[i]] >= (2 if large[i] == a else 1)):
                i -= 1
            if i < 0:
                count = self.left[a]
                first = self._open(count)
                self._place(a, count, first, 0)
                self._add_gap(cap - a, first, count)
                continue
            b = large[i]
            count = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
            first = self._open(count)
            self._place(a, count, first, 0)
            self._place(b, count, first, a)
            self._add_gap(cap - a - b, first, count)

    def _fit_small(self, n: int) -> None:
        """Best fit: the smallest gap that holds the length is filled with as many as it can."""
        while self.left[n]:
            i = bisect.bisect_left(self.gaps, n)
            if i < len(self.gaps):
                gap = self.gaps[i]
                first, size = self.free[gap].pop()
                if not self.free[gap]:
                    del self.free[gap]
                    self.gaps.pop(i)
            else:
                gap, k = self.capacity, self.capacity // n
                size = -(-self.left[n] // k)
                first = self._open(size)
            each = min(gap // n, -(-self.left[n] // size))
            full = min(size, self.left[n] // each)
            for j in range(each if full else 0):
                self._place(n, full, first, self.capacity - gap + j * n)
            self._add_gap(gap - each * n, first, full)
            first, size = first + full, size - full
            if size and self.left[n] and self.left[n] < each:
                rest = self.left[n]
                for j in range(rest):
                    self._place(n, 1, first, self.capacity - gap + j * n)
                self._add_gap(gap - rest * n, first, 1)
                first, size = first + 1, size - 1
            self._add_gap(gap, first, size) if gap < self.capacity else self._forget(first, size)

    def _forget(self, first: int, size: int) -> None:
        if size:  # sequences opened and not used are the last ones
            self.bins = first

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.key, self.first, self.run_rank, self.offset

    def lookup(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lookup(self.arrays(), length, rank)


def lookup(plan: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank among equal lengths."""
    key, first, run_rank, offset = plan
    i = np.searchsorted(key, (length << 44) | rank, side="right") - 1
    return first[i] + rank - run_rank[i], offset[i]


def _salted(df: DataFrame, counts: dict[int, int], rows_per_cell: int) -> tuple[DataFrame, dict]:
    """Spread each length over cells of about ``rows_per_cell`` rows."""
    cells = {n: max(1, -(-c // rows_per_cell)) for n, c in counts.items()}
    table = df.sparkSession.createDataFrame([(int(n), int(c)) for n, c in cells.items()], "length bigint, cells bigint")
    out = df.join(F.broadcast(table), "length")  # at most ``capacity`` rows
    return out.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("cells"))).drop("cells"), cells


def packed(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text", least_cell: int = 100_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    ``least_cell`` is the number of equal-length rows ranked in one task; it rises with the
    table so that at most about 100,000 cell counts reach the driver."""
    cut = written(pieces(df, path, end_id, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    salted, _ = _salted(cut, counts, max(least_cell, total // 100_000))
    plan, base, seen = Plan(counts, capacity), {}, {}
    for r in salted.groupBy("length", "cell").count().orderBy("length", "cell").collect():
        base[r["length"], r["cell"]] = seen.get(r["length"], 0)
        seen[r["length"]] = seen.get(r["length"], 0) + r["count"]
    cells = np.array(sorted(base), np.int64).reshape(-1, 2)
    shared = df.sparkSession.sparkContext.broadcast(
        (plan.arrays(), (cells[:, 0] << 32) | cells[:, 1], np.array([base[k] for k in sorted(base)], np.int64)))
    ranked = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def place(batches):
        runs, keys, starts = shared.value
        for b in batches:
            length, cell, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "cell", "rank"))
            bins, offset = lookup(runs, length, starts[np.searchsorted(keys, (length << 32) | cell)] + rank - 1)
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bins), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "cell", "rank").mapInArrow(place, schema)
