"""Importance resampling, token alignment and fingerprints against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from panelwise.llm import alignment, catalog, chunks, fingerprint, importance
from tests.conftest import SF_SMALL

from .brute import LOWER, sha
from .test_operators import ROWS, docs, empty, rows_of, small_docs  # noqa: F401

SPACED = [(21, "  two  spaces   and\n\n \n ends "), (22, "a▁b c"), (23, "tab\t x\n y 　z \x1c q"), (24, " "), (25, "w " * 3000),
          (26, "<s> <unk> <|endoftext|> <0x0A>"), (27, "x" * 9000 + " end")]


# ---- 11 ------------------------------------------------------------------------------------

def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w))


def resampled(rows, target):
    per = [(d, *features(t)) for d, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in per:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for d, n, f in per:
        weight = sum(gain[b] * c for b, c in f.items())
        h = int(sha(f"42:{'' if d is None else d}".encode())[:8], 16)
        out.append([d, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for i, r in enumerate(drawn[:5 * len(drawn) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


COLS11 = ("doc_id", "n_features", "weight", "score", "rank")


def test_importance(spark, docs, empty):
    target = spark.createDataFrame([("alpha1 beta2 the of and",), (None,)], "text string")
    many = ROWS + [(100 + i, f"alpha{i} " * (i % 40) + "The zeta, eta") for i in range(300)] + [(150, "alpha50 " * 10 + "The zeta, eta")] * 40
    frame = spark.createDataFrame(many, "doc_id bigint, text string")
    assert rows_of(importance.resampled(frame, target), *COLS11) == resampled(many, ["alpha1 beta2 the of and"])
    assert rows_of(importance.resampled(docs, target.limit(0)), *COLS11) == resampled(ROWS, [])
    assert importance.resampled(empty, target).count() == 0


def test_importance_on_the_smallest_tables(spark):
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert rows_of(catalog.op11(spark, SF_SMALL), *COLS11) == resampled(small_docs(spark), target)


def test_importance_draw_leans_to_the_target(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["red", "blue", "green"] if i % 2 else ["one", "two", "three"]) for _ in range(40))) for i in range(600)]
    out = importance.resampled(spark.createDataFrame(rows, "doc_id bigint, text string"),
                               spark.createDataFrame([("red blue green blue red",)], "text string")).where("rank is not null").collect()
    assert len(out) == 30 and all(x.doc_id % 2 for x in out)


# ---- 12 ------------------------------------------------------------------------------------

with open(P.path("byte_bpe_50k.tiktoken"), "rb") as _f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _f)}
A = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def aligned(rows):
    of = {i: b for b, i in RANKS.items()}
    per = []
    for d, text in rows:
        a, b = (A.encode_ordinary(" " + text), B.encode(text)) if text else ([], [])
        pieces = [B.id_to_piece(i) for i in b]
        right = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        left = [of[i] for i in a]
        if not text or not (b"".join(left) == b"".join(right) == b" " + text.encode()):
            per.append((d, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (left, right)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for c in both:
            x, y = i, j
            while i < len(a) and ends[0][i] <= c:
                i += 1
            while j < len(b) and ends[1][j] <= c:
                j += 1
            groups.append((a[x:i], b[y:j]))
            for p in range(x, i):
                for q in range(y, j):
                    if ends[0][p] - len(left[p]) < ends[1][q] and ends[1][q] - len(right[q]) < ends[0][p]:
                        links.append((a[p], b[q]))
        per.append((d, a, b, groups, links))
    count = Counter(p for *_, links in per for p in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for d, a, b, groups, links in per:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links),
                    sum(count[p] for p in links), sha(text.encode()) if text else ""))
    return sorted(out, key=repr)


COLS12 = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(df, **kw):
    return alignment.aligned(df, catalog.BYTE_RANKS, P.PATTERN, catalog.PIECE_MODEL, **kw)


def test_alignment(spark, docs, empty):
    assert rows_of(align(docs), *COLS12) == aligned(ROWS)
    frame = spark.createDataFrame(ROWS + SPACED, "doc_id bigint, text string").repartition(2)
    for size in (2_000, 8e6):  # many blocks and few
        assert rows_of(align(frame, block_bytes=size), *COLS12) == aligned(ROWS + SPACED)
    assert align(empty).count() == 0


def test_alignment_on_the_smallest_tables(spark):
    assert rows_of(catalog.op12(spark, SF_SMALL), *COLS12) == aligned(small_docs(spark))


def test_chunks_join_to_the_texts():
    import pyarrow as pa

    r = random.Random(1)
    texts = ["".join(r.choice("ab \n .\t") for _ in range(r.randrange(12))) for _ in range(3000)]
    bounds, codes, distinct = chunks.chunked(pa.array(texts))
    assert [" ".join(distinct[c] for c in codes[i:j]) for i, j in zip(bounds, bounds[1:])] == texts
    for t, i, j in zip(texts, bounds, bounds[1:]):
        if t:  # A and B of the chunks are those of the text
            parts = [distinct[c] for c in codes[i:j]]
            assert [x for p in parts for x in A.encode_ordinary(" " + p)] == A.encode_ordinary(" " + t), repr(t)
            assert [x for p in parts for x in B.encode(p)] == B.encode(t), repr(t)


# ---- 13 ------------------------------------------------------------------------------------

def plain_fingerprint(text):
    wide, narrow = [0] * 16, [0] * 256
    for p in text.encode().split(b"\n"):
        d = hashlib.shake_128(p).digest(128)
        wide = [(x + int.from_bytes(d[8 * i:8 * i + 8], "little")) % 2 ** 64 for i, x in enumerate(wide)]
        for i in range(len(p) - 7):
            x = int.from_bytes(p[i:i + 8], "little")
            for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ x >> shift) * mul % 2 ** 64
            x ^= x >> 31
            narrow[x >> 1 & 255] += -1 if x & 1 else 1
    return wide, [x % 65536 for x in narrow]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([v - 65536 if v >= 32768 else v for v in f[1]] for f in (a, b))
    size = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return round(min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / size)), 9) if size else 0.0


def plain_compared(rows):
    rows = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 2
        e = t[:len(t) - k] + n[:k]
        f, g, h = plain_fingerprint(t), plain_fingerprint(e), plain_fingerprint(n)
        text = lambda f: "".join(f"{x:016x}" for x in f[0]) + "".join(f"{x:04x}" for x in f[1])
        out.append((d, len(t), sha(e.encode()), text(f), text(g), plain_likeness(f, g), plain_likeness(f, h)))
    return sorted(out, key=repr)


def compared(df, **kw):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in fingerprint.compared(df, **kw).collect()), key=repr)


def test_fingerprints(spark, docs, empty):
    rows = [(d, t) for i, (d, t) in enumerate(ROWS + SPACED) if d not in [x for x, _ in (ROWS + SPACED)[:i]]]  # one row an id
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, part string, tie int").repartition(3)
    for parts in (1, 2, 7):
        assert compared(frame, parts=parts) == plain_compared(rows)
    assert len(compared(docs)) == len(ROWS)  # repeated ids: a row for each
    assert compared(empty) == []
    one = frame.where("doc_id = 1")
    assert compared(one) == plain_compared([r for r in rows if r[0] == 1])
    same = spark.createDataFrame([(5, "equal rows\nof one id")] * 50, "doc_id bigint, text string")
    assert {r.near_next for r in fingerprint.compared(same).collect()} == {1.0} and fingerprint.compared(same).count() == 50


def test_fingerprints_on_the_smallest_tables(spark):
    got = compared(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    assert got == plain_compared(small_docs(spark))
    assert np.mean([r[5] > r[6] for r in got if r[1] > 100]) > 0.97


def test_fingerprint_is_a_multiset_hash():
    lines = [f"line {i % 7} of some text" for i in range(30)] + ["", "short", "x" * 3000]
    f = fingerprint.of_text("\n".join(lines))
    random.Random(2).shuffle(lines)
    assert fingerprint.of_text("\n".join(lines)) == f == fingerprint.fingerprint(lines)
    assert fingerprint.added(fingerprint.removed(f, lines[4]), lines[4]) == f == fingerprint.Fingerprint.from_hex(f.hex())
    assert fingerprint.removed(f, lines[0]) == fingerprint.fingerprint(lines[1:]) != f
    assert fingerprint.likeness(f, fingerprint.fingerprint(lines[1:])) > 0.9
