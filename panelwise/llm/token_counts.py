"""Token counts (operator 9): prefix dynamic programming over byte-level BPE.

For a piece of the splitting pattern, the encoding of a prefix is the encoding of a shorter
prefix plus one token, and that last token is the only vocabulary entry ending there whose
pair with the shorter prefix's last token BPE leaves unmerged.  Filling this from left to
right stores the exact token count of *every* prefix, so totals, budgets and truncation
points are read off without encoding again.  Words repeat, so texts are cut into chunks at single
spaces, each distinct chunk of a batch is counted once, and counts are kept in bounded tables.

Null texts are read as empty (zero tokens); repeated rows give equal rows; an empty table
gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .chunks import chunked, sums_between
from .common import MASK64, BoundedMemo, map_batches, mix64, process_cache, text_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte: printable Latin-1
    bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of all prefixes under one tokenizer file (byte-level BPE JSON)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        # tokens by order of creation: the 256 bytes, then one for each merge
        number = {bytes([i]): i for i in range(256)}
        self.left, self.right, self.merge = [0] * 256, [0] * 256, {}
        for a, b in pairs:
            x, y = number[raw(a)], number[raw(b)]
            number[raw(a) + raw(b)] = self.merge[x, y] = len(self.left)
            self.left.append(x)
            self.right.append(y)
        #: every ending of a token: its number where the ending is a token itself, else -1
        self.ending = {t[i:]: -1 for t in number for i in range(len(t))} | number
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pattern = regex.compile(pattern)
        self.white = regex.compile(r"\s")
        self.pair_ok: dict = BoundedMemo(self._apart, 2_000_000, 2)
        self.spaced_special = any(" " in t for t in special)
        self.whole = BoundedMemo(lambda p: self._prefixes(p.encode())[-1], 300_000)
        self.counted = BoundedMemo(None, 200_000)
        # the same endings by 64-bit polynomial digests, for many pieces at a time
        digest = np.array([self._digest(e) for e in self.ending], np.uint64)
        order = np.argsort(digest)
        self.digests, self.numbers = digest[order], np.array(list(self.ending.values()), np.int64)[order]
        if (self.digests[1:] == self.digests[:-1]).any():
            raise ValueError("two endings of tokens have one digest")
        self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(map(len, self.ending)), _BASE))])
        self.pair_key, self.pair_value = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether BPE leaves the border between two adjacent tokens alone.

        The tokens are taken apart in the reverse order of merging.  At each point the two
        tokens at the border would have merged if their merge comes before the one that
        used the left token, and not after the one that used the right token (equal merges
        are done from the left)."""
        a, b = pair
        a_until = b_until = len(self.left)
        while True:
            c = self.merge.get((a, b))
            if c is not None and c < a_until and c <= b_until:
                return False
            if a > b:
                a_until, a = a, self.right[a]
            elif b < 256:
                return True
            else:
                b_until, b = b, self.left[b]

    def prefixes(self, piece: bytes) -> np.ndarray:
        """Token count of each prefix (0 .. len) of one piece's bytes."""
        return np.asarray(self._prefixes(piece))

    def _prefixes(self, piece: bytes) -> list[int]:
        ending, pair_ok = self.ending, self.pair_ok
        count, last = [0], [-1]
        for i in range(1, len(piece) + 1):
            for j in range(i - 1, -1, -1):
                t = ending.get(piece[j:i])
                if t is None:
                    raise ValueError("the vocabulary has no token for this byte")
                if t >= 0 and (j == 0 or pair_ok[last[j], t]):
                    count.append(count[j] + 1)
                    last.append(t)
                    break  # the last token of a prefix is unique
        return count

    @staticmethod
    def _digest(data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * int(_BASE) + b + 1) & MASK64
        return h

    def _apart_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``pair_ok`` of many pairs, kept in a table with one place for each hash."""
        key = a * len(self.left) + b
        place = (mix64(key.astype(np.uint64)) & np.uint64(len(self.pair_key) - 1)).astype(np.int64)
        new = np.flatnonzero(self.pair_key[place] != key)
        out = self.pair_value[place]
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            known = np.array([self._apart(divmod(k, len(self.left))) for k in pairs.tolist()], bool)
            out[new] = known[back]
            self.pair_key[place[new]], self.pair_value[place[new]] = key[new], out[new]
        return out

    def _totals(self, pieces: list[bytes]) -> np.ndarray:
        """Token count of each whole piece: the prefixes of all pieces grow together, and at each
        length the endings are tried from the shortest on."""
        if not pieces:
            return np.empty(0, np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        longest = int(size[0])
        data = np.frombuffer(b"".join([pieces[i].ljust(longest, b"\0") for i in order.tolist()]), np.uint8).reshape(-1, longest)
        digest = np.zeros((longest + 1, len(pieces)), np.uint64)
        for i in range(longest):
            digest[i + 1] = digest[i] * _BASE + (data[:, i].astype(np.uint64) + np.uint64(1))
        count, last = np.zeros((longest + 1, len(pieces)), np.int64), np.full((longest + 1, len(pieces)), -1, np.int64)
        for i in range(1, longest + 1):
            left = np.arange(np.searchsorted(-size, -i, side="right"))  # pieces at least this long
            for n in range(1, i + 1):
                if not len(left):
                    break
                if n >= len(self.powers):
                    raise ValueError("the vocabulary has no token for this byte")
                h = digest[i, left] - digest[i - n, left] * self.powers[n]
                at = np.minimum(np.searchsorted(self.digests, h), len(self.digests) - 1)
                if (self.digests[at] != h).any():
                    raise ValueError("the vocabulary has no token for this byte")
                token = self.numbers[at]
                fit = token >= 0
                if n < i:
                    some = np.flatnonzero(fit)
                    fit[some] = self._apart_many(last[i - n, left[some]], token[some])
                done = left[fit]
                count[i, done] = count[i - n, done] + 1
                last[i, done] = token[fit]
                left = left[~fit]
        out = np.empty(len(pieces), np.int64)
        out[order] = count[size, np.arange(len(pieces))]
        return out

    def _counts(self, chunks: list[str]) -> np.ndarray:
        """Token counts of chunks; pieces first seen are counted together."""
        out = [self.counted.known(c) for c in chunks]
        new = [i for i, v in enumerate(out) if v is None]
        split, special = self.pattern.findall, self.special
        parts = []
        for i in new:
            c = chunks[i]
            if special is not None and "<" in c:
                seg = special.split(c)
                parts.append((len(seg) // 2, [p for s in seg[::2] for p in split(s)]))
            else:
                parts.append((0, split(c)))
        seen = {p: self.whole.known(p) for p in set().union(*(x for _, x in parts))}
        fresh = [p for p, v in seen.items() if v is None]
        short = [p for p in fresh if len(p) <= 32]
        seen.update(zip(short, self._totals([p.encode() for p in short]).tolist()))
        seen.update((p, self._prefixes(p.encode())[-1]) for p in fresh if len(p) > 32)
        for p in fresh:
            self.whole.keep(p, seen[p])
        for i, (n, x) in zip(new, parts):
            out[i] = n + sum([seen[p] for p in x])
            self.counted.keep(chunks[i], out[i])
        return np.array(out, np.int64)

    def _chunk(self, text: str) -> int:
        whole = self.whole
        return sum(whole[p] for p in self.pattern.findall(text))

    def _ordinary(self, text: str) -> int:
        """Count of a text without special strings."""
        return self._chunk(text)

    def segments(self, text: str) -> list[str]:
        return self.special.split(text) if self.special else [text]

    def count(self, text: str) -> int:
        """Tokens of the whole text; a special string inside it is one token."""
        if self.special is None or "<" not in text:
            return self._ordinary(text)
        return sum(1 if i % 2 else self._ordinary(s) for i, s in enumerate(self.segments(text)))

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(byte end, token count so far) of every piece: the prefixes that end with a piece."""
        ends, counts, at, n = [0], [0], 0, 0
        for i, s in enumerate(self.segments(text)):
            for p in ([s] if i % 2 else self.pattern.findall(s)):
                at, n = at + len(p.encode()), n + (1 if i % 2 else self.whole[p])
                ends.append(at)
                counts.append(n)
        return np.asarray(ends), np.asarray(counts)

    def table(self, text: str) -> np.ndarray:
        """Exact token count of ``text[:k]`` for every k from 0 to its length."""
        out, base = [np.zeros(1, np.int64)], 0
        parts = self.segments(text)
        for i, s in enumerate(parts):
            if i % 2:  # an unfinished special string is ordinary text after the part before it
                before = parts[i - 1]
                lead = base - self._ordinary(before)
                inside = [lead + self._ordinary(before + s[:c]) for c in range(1, len(s))]
                base += 1
                out.append(np.asarray([*inside, base]))
            elif s:
                counts = self._plain_table(s)
                out.append(base + counts)
                base += int(counts[-1])
        return np.concatenate(out)

    def _plain_table(self, text: str) -> np.ndarray:
        """Counts after each character.  A prefix splits like the text up to its last piece, and
        that piece's own prefixes give the rest.  Two cases differ: a prefix that ends in white
        space has the whole run as one piece, and an unfinished contraction is two pieces."""
        out, at, n, run = np.zeros(len(text), np.int64), 0, 0, None
        for piece in self.pattern.findall(text):
            after = np.cumsum([len(c.encode()) for c in piece])
            out[at:at + len(piece)] = n + self.prefixes(piece.encode())[after]
            if len(piece) == 3 and piece[0] == "'" and piece[1:].isalpha():
                out[at + 1] = n + 2
            if self.white.match(piece):
                run = run or (at, n)
                end = at
                while end < len(text) and self.white.match(text[end]):
                    end += 1
                white = text[run[0]:end]
                sizes = np.cumsum([len(c.encode()) for c in white])
                held = run[1] + self.prefixes(white.encode())[sizes]
                stop = min(end, at + len(piece))
                out[at:stop] = held[at - run[0]:stop - run[0]]
                if stop < at + len(piece):
                    run = None
            else:
                run = None
            n += self.whole[piece]
            at += len(piece)
        return out

    def cut(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix made of whole pieces that has at most ``budget`` tokens."""
        ends, counts = self.ends(text)
        return int(ends[np.searchsorted(counts, budget, side="right") - 1])

    def of_texts(self, texts: pa.Array, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, tokens, ``cut`` at the budget) of whole texts.  Texts are cut into chunks at single
        spaces, where the pattern always separates; a distinct chunk of a batch is counted once."""
        if self.spaced_special:  # a special string that holds a space may lie across chunks
            rows = [(len(t.encode()), self.count(t), self.cut(t, budget)) for t in texts.to_pylist()]
            return tuple(np.array(x, np.int64) for x in zip(*rows))
        bounds, codes, chunks = chunked(texts)
        size = np.array([len(c.encode()) for c in chunks], np.int64) + 1
        spaced = self._counts([" " + c for c in chunks])
        n, b = spaced[codes], size[codes]
        first = codes[bounds[:-1]]  # the first chunk of a text has no space before it
        at, back = np.unique(first, return_inverse=True)
        n[bounds[:-1]] = self._counts([chunks[i] for i in at.tolist()])[back]
        b[bounds[:-1]] -= 1
        n_tokens, n_bytes = sums_between(n, bounds), sums_between(b, bounds)
        cuts = n_bytes.copy()
        for i in np.flatnonzero(n_tokens > budget).tolist():
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            before = np.cumsum(n[lo:hi])
            k = int(np.searchsorted(before, budget, side="right"))  # the chunk that goes beyond
            text = (" " if k else "") + chunks[codes[lo + k]]
            cuts[i] = b[lo:lo + k].sum() + self.cut(text, budget - (int(before[k - 1]) if k else 0))
        return n_bytes, n_tokens, cuts


def counter(path: str, pattern: str) -> PrefixCounter:
    cache, key = process_cache(), ("prefix", path, pattern)
    if key not in cache:
        cache[key] = PrefixCounter(path, pattern)
    return cache[key]


def token_counts(df: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_bytes: ``limit_bytes`` is where the text is
    cut (at the end of a piece) to have at most ``limit`` tokens; all bytes if it has no more."""
    def one(batch: pa.RecordBatch) -> dict:
        n_bytes, n_tokens, cuts = counter(path, pattern).of_texts(batch.column("text"), limit)
        return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens,
                "over_limit": n_tokens > limit, "limit_bytes": cuts}

    return map_batches(text_rows(df, id_col, text_col, "doc_id"), one,
                       "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_bytes bigint")
