"""Cross-tokenizer alignment (operator 12): interval coalescing over two tokenizations.

A is a byte-level BPE (tiktoken ranks), B a sentencepiece model; A reads a space before the
text, as B adds one.  Both separate at single spaces, so the tokens of a text are those of its
chunks (``chunks.chunked``), and each distinct chunk of a block is aligned once: all A and B
tokens are sorted by start, the running maximum of their ends is taken, and a group breaks where
a start reaches it; inside, each A token is linked with the B tokens that it overlaps.

How many documents hold an id pair linked is counted in three steps, without a row for each link:

1. a block of documents (one Arrow slice, about 3 MB of text) writes its distinct pairs with the
   number of its documents that hold them, its chunks as lists of those pairs, and its documents
   as lists of those chunks;
2. pairs are summed over blocks and joined back to the blocks (a row for a block and pair);
3. a block's pairs, chunks and documents meet again, in this order, in one partition, and sums
   over a document's links are sums over its chunks.

A block's dictionary is bounded by the block.  The best count of each A id is at most one row for
each id of the vocabulary, and is broadcast.

Texts that are null, empty, or whose joined token bytes differ from space + text (a literal
U+2581, say) have no tokens: zeros and an empty string.  Rows are documents: repeated rows and
null ids count once each.  An empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode, encoding, read_ranks
from .chunks import chunked, distinct, slices_of, sums_between
from .common import map_batches, process_cache, text_rows, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Kinds of rows of a block, in the order in which they are read back.
_PAIR, _CHUNKS, _DOC = 0, 1, 2
_STEP1 = ("block bigint, kind int, pos int, a int, b int, n bigint, doc_id bigint, n_a bigint, n_b bigint, "
          "n_groups bigint, n_links bigint, groups_sha256 string, body binary")


class Tokenizers:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        import sentencepiece

        self.a = encoding(ranks_path, pattern)
        ranks = read_ranks(ranks_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.n_ids = max(len(self.a_bytes), len(self.b_bytes))
        #: decimal ids after each mark of a chunk's groups: none (its start), group, side, token
        self.marked = [mark + str(i) for mark in ("", ";", "|", ",") for i in range(self.n_ids)]

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _alone(self, chunk: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """A ids and B ids of space + chunk, and whether both give its bytes back."""
        x, y = encode(" " + chunk, self.a), np.asarray(self.b.encode(chunk), np.int64)
        want = b" " + chunk.encode()
        ok = b"".join([self.b_bytes[t] for t in y.tolist()]) == want == b"".join([self.a_bytes[t] for t in x.tolist()])
        return x, y, ok

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, their number in each chunk, B ids, their number, and whether both give the bytes of
        space + chunk back (else the chunk has none).  An empty chunk has no ids.

        Both tokenizers separate at a single space between other characters, so many chunks are
        handed over as one text and its ids are dealt out by bytes."""
        runs, size, plain = [[]], 0, []
        for i, c in enumerate(chunks):
            if c and len(c) < 4096 and not c[0].isspace() and not c[-1].isspace() and "\u2581" not in c:
                runs[-1].append(i)
                size += len(c) + 1
                if size > 8192:
                    runs.append([])
                    size = 0
            elif c:
                plain.append(i)
        runs = [run for run in runs if run]
        texts = [" ".join([chunks[i] for i in run]) for run in runs]
        order, ids, counts = [], ([], []), ([], [])
        for run, text, y in zip(runs, texts, self.b.encode(texts, num_threads=1) if texts else ()):
            data, y = b" " + text.encode(), np.asarray(y, np.int64)
            x = self.a.encode_to_numpy(" " + text).astype(np.int64)
            ends = np.cumsum([len(chunks[i].encode()) + 1 for i in run])
            x_end, y_end = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
            x_cut, y_cut = np.searchsorted(x_end, ends) + 1, np.searchsorted(y_end, ends) + 1
            if (b"".join([self.a_bytes[t] for t in x.tolist()]) == data == b"".join([self.b_bytes[t] for t in y.tolist()])
                    and (x_end[x_cut - 1] == ends).all() and (y_end[y_cut - 1] == ends).all()):
                order += run
                for side, z, cut in ((0, x, x_cut), (1, y, y_cut)):
                    ids[side].append(z)
                    counts[side].append(np.diff(cut, prepend=0))
            else:
                plain += run
        ok = np.ones(len(chunks), bool)
        for i in plain:
            x, y, ok[i] = self._alone(chunks[i])
            if ok[i]:
                order.append(i)
                for side, z in ((0, x), (1, y)):
                    ids[side].append(z)
                    counts[side].append([len(z)])
        out = []
        for side in (0, 1):
            flat = np.concatenate([np.empty(0, np.int64), *ids[side]]).astype(np.int64)
            n = np.concatenate([np.empty(0, np.int64), *counts[side]]).astype(np.int64)
            number, start = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
            number[order], start[order] = n, np.cumsum(n) - n
            out += [flat[slices_of(start, number)], number]
        return *out, ok


def tokenizers(ranks_path: str, pattern: str, model_path: str) -> Tokenizers:
    cache, key = process_cache(), ("aligned", ranks_path, pattern, model_path)
    if key not in cache:
        cache[key] = Tokenizers(ranks_path, pattern, model_path)
    return cache[key]


def coalesced(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and each B token of one byte string: sorted by start, a group breaks where
    a start reaches the running maximum of the ends so far."""
    size = np.concatenate([a_size, b_size])
    end = np.concatenate([np.cumsum(a_size), np.cumsum(b_size)])
    start = end - size
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(size), np.int64)
    group[order] = np.cumsum(np.concatenate([[1], start[order][1:] >= reach[:-1]])) - 1 if len(size) else 0
    return group[:len(a_size)], group[len(a_size):]


def overlaps(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (A, B) of all tokens that share a byte."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    first = np.searchsorted(b_end, a_end - a_size, side="right")
    count = np.searchsorted(b_end - b_size, a_end, side="left") - first
    return np.repeat(np.arange(len(a_size)), count), slices_of(first, count)


class Block:
    """Distinct chunks of a block, aligned."""

    def __init__(self, chunks: list[str], t: Tokenizers):
        a_id, self.n_a, b_id, self.n_b, self.ok = t.encode(chunks)
        a_size, b_size = t.a_size[a_id], t.b_size[b_id]
        a_of, b_of = (np.repeat(np.arange(len(chunks)), n) for n in (self.n_a, self.n_b))
        a_group, b_group = coalesced(a_size, b_size)
        i, j = overlaps(a_size, b_size)
        self.n_links = np.bincount(a_of[i], minlength=len(chunks))
        self.pairs, self.pair_of = np.unique(a_id[i] << 32 | b_id[j], return_inverse=True)
        self.link_start = np.cumsum(self.n_links) - self.n_links
        new = np.concatenate([[True], a_group[1:] != a_group[:-1]]) if len(a_group) else np.empty(0, bool)
        self.n_groups = np.bincount(a_of[new], minlength=len(chunks))
        self.text = self._texts(t, a_id, b_id, a_of, b_of, a_group, b_group, len(chunks))

    @staticmethod
    def _texts(t, a_id, b_id, a_of, b_of, a_group, b_group, n: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each chunk."""
        side = np.concatenate([np.zeros(len(a_id), np.int8), np.ones(len(b_id), np.int8)])
        group, owner = np.concatenate([a_group, b_group]), np.concatenate([a_of, b_of])
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        side, group, owner = side[order], group[order], owner[order]
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.empty(0, bool)
        head = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(group) else first
        turn = np.concatenate([[False], side[1:] > side[:-1]]) if len(group) else first
        mark = np.where(head, 0, np.where(first, 1, np.where(turn, 2, 3)))
        marked = t.marked
        parts = [marked[i] for i in (mark * t.n_ids + np.concatenate([a_id, b_id])[order]).tolist()]
        ends = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        return ["".join(parts[x:y]) for x, y in zip([0, *ends], ends)]


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in two or four bytes each, after a byte that says which."""
    kind = "<u2" if not len(x) or x.max() < 65_536 else "<u4"
    return kind[2].encode() + x.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int64)


def _block_rows(batch: pa.RecordBatch, t: Tokenizers, block: int) -> dict:
    """Pairs, chunks and documents of one block as rows."""
    bounds, codes, chunks = chunked(batch.column("text"))
    b = Block(chunks, t)
    n_docs = batch.num_rows
    bad = sums_between(~b.ok[codes], bounds) > 0
    owner = np.repeat(np.arange(n_docs), np.diff(bounds))
    keep = ~bad[owner]
    owner, codes = owner[keep], codes[keep].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))])
    # documents that hold a pair: distinct (document, chunk), then distinct (document, pair)
    once = distinct(owner << 32 | codes)
    doc, code = once >> 32, once & 0xFFFFFFFF
    held = distinct(np.repeat(doc, b.n_links[code]) << 32 | b.pair_of[slices_of(b.link_start[code], b.n_links[code])])
    df = np.bincount(held & 0xFFFFFFFF, minlength=len(b.pairs))
    shas = []
    code_list, bound_list = codes.tolist(), bounds.tolist()
    for i, j in zip(bound_list, bound_list[1:]):
        text = ";".join([s for s in [b.text[c] for c in code_list[i:j]] if s])
        shas.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
    step = 65_536
    cuts = range(0, len(chunks), step)
    bodies = []
    for c in cuts:
        n = b.n_links[c:c + step]
        links = b.pair_of[b.link_start[c]:b.link_start[c] + n.sum()] if len(n) else b.pair_of[:0]
        sizes = _packed(n)
        bodies.append(len(sizes).to_bytes(4, "little") + sizes + _packed(links))
    n_p, n_c = len(b.pairs), len(bodies)
    none = lambda k: [None] * k
    per_doc = [sums_between(x[codes], bounds) for x in (b.n_a, b.n_b, b.n_groups, b.n_links)]
    rows = n_p + n_c + n_docs
    out = {"block": np.full(rows, block), "kind": np.repeat([_PAIR, _CHUNKS, _DOC], [n_p, n_c, n_docs]),
           "pos": np.concatenate([np.arange(n_p), np.arange(n_c), np.arange(n_docs)]),
           "a": [*(b.pairs >> 32).tolist(), *none(n_c + n_docs)], "b": [*(b.pairs & 0xFFFFFFFF).tolist(), *none(n_c + n_docs)],
           "n": [*df.tolist(), *none(n_c + n_docs)], "doc_id": [*none(n_p + n_c), *batch.column("doc_id").to_pylist()],
           "groups_sha256": [*none(n_p + n_c), *shas],
           "body": [*none(n_p), *bodies, *[_packed(codes[i:j]) for i, j in zip(bound_list, bound_list[1:])]]}
    for name, values in zip(("n_a", "n_b", "n_groups", "n_links"), per_doc):
        out[name] = [*none(n_p + n_c), *values.tolist()]
    return out


class _Reader:
    """Pairs, then chunks, then documents of one block after another, in batches."""

    def __init__(self):
        self.block, self.counts, self.best, self.bodies, self.sums = None, [], [], [], None

    def _settle(self) -> None:
        """Sums over the links of each chunk."""
        count, best = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.counts, self.best))
        sizes, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for body in self.bodies:
            n = 4 + int.from_bytes(body[:4], "little")
            sizes.append(_unpacked(body[4:n]))
            links.append(_unpacked(body[n:]))
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        link = np.concatenate(links)
        self.sums = (sums_between(best[link], bounds), sums_between(count[link], bounds))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        for batch in batches:
            block = batch.column("block").to_numpy()
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                if j <= i:
                    continue
                part = batch.slice(i, j - i)
                if block[i] != self.block:
                    self.__init__()
                    self.block = block[i]
                if kind[i] == _PAIR:
                    self.counts.append(part.column("n").to_numpy())
                    self.best.append(part.column("best").to_numpy())
                elif kind[i] == _CHUNKS:
                    self.bodies += part.column("body").to_pylist()
                else:
                    if self.sums is None:
                        self._settle()
                    codes = [_unpacked(x) for x in part.column("body").to_pylist()]
                    ends = np.cumsum([0, *map(len, codes)])
                    flat = np.concatenate(codes)
                    n_best, count_sum = (pa.array(sums_between(s[flat], ends)) for s in self.sums)
                    extra = {"n_best": n_best, "count_sum": count_sum}
                    yield pa.RecordBatch.from_arrays([extra[n] if n in extra else part.column(n) for n in names], names)


def aligned(df: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id",
            text_col: str = "text", block_bytes: float = 3e6) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    state = {"n": 0}

    def one(batch: pa.RecordBatch) -> dict:
        block = (TaskContext.get().partitionId() << 32) + state["n"]
        state["n"] += 1
        return _block_rows(batch, tokenizers(ranks_path, pattern, model_path), block)

    rows = written(map_batches(text_rows(df, id_col, text_col, "doc_id"), one, _STEP1, block_bytes), "aligned")
    pairs = rows.where(F.col("kind") == _PAIR).select("block", "pos", "a", "b", "n")
    total = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    top = total.groupBy("a").agg(F.max("n").alias("top"))  # at most one row for each id of the vocabulary
    marked = total.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("top")).cast("bigint").alias("best"))
    counted = pairs.drop("n").join(marked, ["a", "b"]).select("block", F.lit(_PAIR).alias("kind"), "pos", "n", "best")
    others = rows.where(F.col("kind") != _PAIR).drop("a", "b", "n")
    whole = counted.unionByName(others, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "pos")
    return whole.mapInArrow(lambda batches: _Reader()(batches),
                            "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                            "count_sum bigint, groups_sha256 string")
