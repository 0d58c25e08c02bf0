"""Language-model scoring (operator 4): a log-bilinear neural model in numpy, trained with
noise-contrastive estimation.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end token a text.  All token counts
of the training texts are exact and stay distributed.  The model predicts *symbols*: the most
frequent words, and for all others a class by the word's last three bytes; inside a class a
word has its share of the class's training count, with one added for each word and for words
never seen.  So the model is a proper distribution over the training words and one unknown
word a class.

The log-bilinear part: each of the two symbols before a position has a vector, scaled by a
vector for its distance; their sum, multiplied with the vector of a next symbol, plus that
symbol's bias, is its score.  Every task trains on all tokens of its shard, from a common start,
and the parameters are averaged in a tree, weighted by tokens.  Shards are made by a hash of
text and id and read in its order, so scores do not depend on how the input is partitioned.  Because a
score is a sum of one term for each context position, one matrix product gives the terms of all
pairs of symbols, and another (of their exponentials) the normalisers of all pairs of context
symbols; a token's normalised log-probability is then a few look-ups.

Words that are neither among the symbols nor among the ``KNOWN`` most frequent words (whose
counts are sent to the tasks, in bounded size) are joined with the count table.

Null texts are read as empty: the end token alone.  Repeated rows give equal rows; a null id
counts as training.  With no training text all counts are zero.  An empty table gives an empty
result; extra input columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from itertools import repeat
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows, words_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words with at least one in so many tokens have a symbol each; classes of the others; size of the vectors.
SHARE, CLASSES, WIDTH = 20_000, 256, 32
#: Frequent words of a model that is given no counts.
HEAD = 768
#: Words whose counts are sent to every task, and their longest (both bound the broadcast).
KNOWN, LONGEST = 200_000, 32
#: Tokens of one update, noise symbols of one update, step, tokens of a training shard at least.
BATCH, NOISE, STEP, SHARD_TOKENS = 4_096, 64, 0.1, 2_000_000
#: The end token is the only "word" without bytes.
END = b""


def tokens(text: str) -> list[bytes]:
    out = words_of(text.encode())
    out.append(END)
    return out


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


# ---- counts ------------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of the training texts; each task adds up its own words first."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for text in b.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > 400_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.where("NOT held_out").select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Bounded part of the counts: head words, known words, totals of the classes."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = total["n"], total["v"]
        short = counts.where(F.length("word") <= LONGEST)
        # count bands: at most a few hundred rows whatever the vocabulary
        band = F.floor(F.log2("c") * 16)
        bands = sorted(short.groupBy(band.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r["b"])
        least, room = None, KNOWN
        for r in bands:
            room -= r["n"]
            if room < 0:
                break
            least = r["least"]
        rows = short.where(F.col("c") >= F.lit(least)).collect() if least is not None else []
        self.known = {bytes(r["word"]): r["c"] for r in rows}
        if END not in self.known and self.n:
            self.known[END] = counts.where(F.length("word") == 0).first()["c"]
        head = sorted((w for w, c in self.known.items() if w == END or c * SHARE >= self.n), key=lambda w: (w != END, -self.known[w], w))
        self.head = {w: i for i, w in enumerate(head)}
        cls = F.pmod(F.crc32(F.expr("substring(word, -3)")), F.lit(CLASSES))
        tail = counts.groupBy(cls.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES rows
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in tail:
            self.class_n[r["k"]], self.class_v[r["k"]] = r["n"], r["v"]
        for w in head:
            self.class_n[word_class(w)] -= self.known[w]
            self.class_v[word_class(w)] -= 1
        self.symbol_n = np.concatenate([[self.known[w] for w in head], self.class_n])


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(bounds, codes, distinct words) of the tokens of texts; the last distinct "word" is the end token,
    which closes each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten().dictionary_encode()
    codes, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary.cast(pa.binary()).to_pylist()
    ends = np.asarray(lists.offsets).astype(np.int64)
    ends = ends[1:] - ends[0]
    real = np.ones(len(codes), bool)
    if b"" in distinct:  # white space at an end of a text
        real = codes != distinct.index(b"")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
    codes = np.insert(codes[real], ends, len(distinct))
    return np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]), codes, [*distinct, END]


def slices(batches: Iterable[pa.RecordBatch], size: float = 4e6) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


# ---- the model ---------------------------------------------------------------------------

def shapes(symbols: int) -> tuple:
    """Context vectors (one more, the start of a text, occurs in contexts only), target vectors, position
    vectors, biases."""
    return (symbols + 1, WIDTH), (symbols, WIDTH), (2, WIDTH), (symbols,)


SYMBOLS = HEAD + CLASSES
_SHAPES = shapes(SYMBOLS)


def split_parameters(flat: np.ndarray) -> list[np.ndarray]:
    """Context vectors, target vectors, position vectors, biases."""
    out, at = [], 0
    for shape in shapes((len(flat) - 3 * WIDTH) // (2 * WIDTH + 1)):
        n = int(np.prod(shape))
        out.append(flat[at:at + n].reshape(shape))
        at += n
    return out


def first_parameters(symbol_n: np.ndarray, seed: int = 1) -> np.ndarray:
    """Small random vectors, and the log frequency of each symbol as its bias."""
    rng = np.random.default_rng(seed)
    r, t = (rng.normal(0, 0.1, s) for s in shapes(len(symbol_n))[:2])
    p = (symbol_n + 0.5) / (symbol_n + 0.5).sum()
    return np.concatenate([r.ravel(), t.ravel(), np.ones(2 * WIDTH), np.log(p)]).astype(np.float32)


def _add_rows(target: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """target[at] += rows, equal places added up (sorted runs; faster than add.at)."""
    o = np.argsort(at)
    at = at[o]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    target[at[start]] += np.add.reduceat(rows[o], start, axis=0)


class Trainer:
    """Noise-contrastive estimation with Adagrad steps."""

    def __init__(self, flat: np.ndarray, noise: np.ndarray, seed: int = 2):
        self.flat = flat.copy()
        self.parts = split_parameters(self.flat)
        self.squares = [np.full(x.shape, 1e-3, np.float32) for x in self.parts]
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.edges, self.rng = np.cumsum(noise), np.random.default_rng(seed)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        """One update from targets and the symbols one and two places before them."""
        r, t, pos, bias = self.parts
        a, b = r[one], r[two]
        q = a * pos[0] + b * pos[1]
        tt = t[target]
        symbols = len(t)
        drawn = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), symbols - 1)
        td = t[drawn]
        up = np.einsum("ij,ij->i", q, tt) + (bias - self.log_noise)[target]
        down = q @ td.T + (bias - self.log_noise)[drawn]
        g_up = -0.5 + 0.5 * np.tanh(0.5 * up)  # data: pull up (minus the logistic of -up)
        g_down = 0.5 + 0.5 * np.tanh(0.5 * down)  # noise: push down
        dq = g_up[:, None] * tt + g_down @ td
        grads = [np.zeros(x.shape, np.float32) for x in self.parts]
        _add_rows(grads[0], one, dq * pos[0])
        _add_rows(grads[0], two, dq * pos[1])
        _add_rows(grads[1], target, g_up[:, None] * q)
        _add_rows(grads[1], drawn, g_down.T @ q)
        grads[2][0], grads[2][1] = (dq * a).sum(axis=0), (dq * b).sum(axis=0)
        grads[3] += np.bincount(target, g_up, symbols).astype(np.float32)
        grads[3] += np.bincount(drawn, g_down.sum(axis=0), symbols).astype(np.float32)
        for p, g, s in zip(self.parts, grads, self.squares):
            g /= len(target) / 64
            s += g * g
            p -= STEP * g / np.sqrt(s)


def contexts(ids: list[np.ndarray], start: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one before, two before, target) of texts laid end to end; ``start`` stands before a text."""
    return laid_out(np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]]), start)


def laid_out(target: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.concatenate([[start], target[:-1]])
    two = np.concatenate([[start, start], target[:-2]])[:len(target)]
    one[first] = start
    two[first] = start
    second = first + 1
    two[second[second < len(target)]] = start
    return one, two, target


def trained(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Parameters after one pass over all training texts."""
    flat = first_parameters(vocabulary.symbol_n)
    if not vocabulary.n:
        return flat
    noise = (vocabulary.symbol_n + 0.5) / (vocabulary.symbol_n + 0.5).sum()
    shared = docs.sparkSession.sparkContext.broadcast((flat, noise, vocabulary.head))

    def run(batches):
        flat, noise, head = shared.value
        n_head, trainer, seen = len(head), Trainer(flat, noise, 2 + TaskContext.get().partitionId()), 0
        for part in slices(batches, 1e6):
            bounds, codes, words = numbered(part.column(0))
            symbol = np.array([head.get(w, -1) for w in words], np.int64)
            tail = np.flatnonzero(symbol < 0)
            symbol[tail] = [n_head + word_class(words[i]) for i in tail.tolist()]
            triples = laid_out(symbol[codes], bounds[:-1], len(noise))
            order = trainer.rng.permutation(len(codes))
            for i in range(0, len(order), BATCH):
                trainer.step(*(x[order[i:i + BATCH]] for x in triples))
            seen += len(codes)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([trainer.flat.tobytes()], pa.binary())], names=["n", "flat"])

    texts = docs.where("NOT held_out").select("version", "doc_id", "text")
    shards = max(1, vocabulary.n // SHARD_TOKENS)
    # by a hash of text and id and in its order: the same shards however the input is partitioned, and
    # copies of one text are spread
    key = ["version", "doc_id"]
    texts = texts.repartition(int(shards), *key).sortWithinPartitions(*key).select("text")
    rows = written(texts.mapInArrow(run, "n double, flat binary").withColumn(
        "k", F.monotonically_increasing_id()), "parameters")
    n = rows.count()
    while n > 16:  # a tree: groups of about 16 are averaged where they are
        rows = written(rows.withColumn("k", F.pmod(F.xxhash64("k"), F.lit(max(1, n // 16)))).repartition("k")
                       .sortWithinPartitions("k").mapInArrow(_averages, "n double, flat binary, k bigint"), "parameters")
        n = rows.count()
    return average([(r["n"], bytes(r["flat"])) for r in rows.collect()])


def average(rows: list[tuple[float, bytes]]) -> np.ndarray:
    total = sum(n for n, _ in rows)
    return sum(np.frombuffer(f, np.float32).astype(np.float64) * (n / total) for n, f in rows).astype(np.float32)


def _averages(batches):
    from .minhash import grouped

    for rows in grouped(batches, ["k"]):
        yield pa.RecordBatch.from_arrays(
            [pa.array([sum(r["n"] for r in rows)]), pa.array([average([(r["n"], r["flat"]) for r in rows]).tobytes()], pa.binary()),
             pa.array([rows[0]["k"]], pa.int64())], names=["n", "flat", "k"])


class Tables:
    """Terms of all pairs of symbols, and the normaliser of all pairs of context symbols."""

    def __init__(self, flat: np.ndarray):
        r, t, pos, bias = split_parameters(flat)
        self.one = (r * pos[0]) @ t.T + bias
        self.two = (r * pos[1]) @ t.T
        # the sum over next symbols of exp(one + two) is a product of exponentials
        top_one, top_two = (x.max(axis=1, keepdims=True) for x in (self.one, self.two))
        z = np.exp((self.one - top_one).astype(np.float64)) @ np.exp((self.two - top_two).astype(np.float64)).T
        self.log_z = (np.log(z) + top_one + top_two.T).astype(np.float32)

    def log10(self, ids: list[np.ndarray]) -> np.ndarray:
        """Normalised log10 probability of each symbol after the two before it."""
        return self.of(*contexts(ids, len(self.one) - 1))

    def of(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.one[one, target].astype(np.float64) + self.two[two, target] - self.log_z[one, two]) / np.log(10)


# ---- the operator ------------------------------------------------------------------------

def held_out(id_col: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = text_rows(df, id_col, text_col, "doc_id").withColumn("held_out", held_out(F.col("doc_id"))).withColumn("version", F.xxhash64("text"))
    counts = written(word_counts(docs), "counts")
    vocabulary = Vocabulary(counts)
    tables = Tables(trained(docs, vocabulary))
    n, v = vocabulary.n, vocabulary.v
    class_all = np.log10(vocabulary.class_n + vocabulary.class_v + 1)
    shared = df.sparkSession.sparkContext.broadcast(
        ((tables.one, tables.two, tables.log_z), vocabulary.known, vocabulary.head, class_all, float(np.log10(n + v + 1))))
    names = ("doc_id", "version", "word", "tf", "held_out", "n_tokens", "n_known", "base", "model")

    def run(batches):
        (one, two, log_z), known, head, class_all, base_all = shared.value
        t = Tables.__new__(Tables)
        t.one, t.two, t.log_z = one, two, log_z
        # known words by number: symbol, base part, and part of the model's score inside its class;
        # the last entry is for rare words, whose parts are added by the join
        number = {w: i for i, w in enumerate(known)}
        n_head, start = len(head), len(one) - 1
        cls = np.array([word_class(w) for w in known] + [0])
        is_head = np.array([head.get(w, -1) for w in known] + [-1])
        log_c = np.log10(np.array(list(known.values()) + [0], np.float64) + 1)
        symbol, rare_at = np.where(is_head >= 0, is_head, n_head + cls), len(known)
        base, inner = log_c - base_all, np.where(is_head >= 0, 0.0, log_c - class_all[cls])
        base[-1] = inner[-1] = 0.0
        for part in slices(batches):
            bounds, codes, words = numbered(part.column("text"))
            n, sizes = part.num_rows, np.diff(bounds)
            at = np.fromiter(map(number.get, words, repeat(rare_at)), np.int64, len(words))
            rare = at == rare_at
            sym = symbol[at]
            sym[rare] = [n_head + word_class(words[i]) for i in np.flatnonzero(rare).tolist()]
            model = np.add.reduceat(t.of(*laid_out(sym[codes], bounds[:-1], start)) + inner[at][codes], bounds[:-1])
            bases = np.add.reduceat(base[at][codes], bounds[:-1])
            far = np.flatnonzero(rare[codes])
            owner = np.repeat(np.arange(n), sizes)[far]
            pairs, times = np.unique(owner << 32 | codes[far], return_counts=True)
            row, word = pa.array(pairs >> 32), pairs & 0xFFFFFFFF
            m = len(pairs)
            zero, none = np.zeros(m, np.int64), pa.nulls(m, pa.bool_())
            columns = {
                "doc_id": [part.column("doc_id"), part.column("doc_id").take(row)], "version": [part.column("version"), part.column("version").take(row)],
                "word": [pa.nulls(n, pa.binary()), pa.array([words[i] for i in word.tolist()], pa.binary())],
                "tf": [pa.array(np.ones(n, np.int64)), pa.array(times.astype(np.int64))], "held_out": [part.column("held_out"), none],
                "n_tokens": [pa.array(sizes), pa.array(zero)],
                "n_known": [pa.array(sizes - np.bincount(owner, minlength=n)), pa.array(zero)],
                "base": [pa.array(bases), pa.array(zero.astype(np.float64))], "model": [pa.array(model), pa.array(zero.astype(np.float64))]}
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(y) for x in columns[c]]) for c, y in zip(names, types)], names=list(names))

    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = "doc_id bigint, version bigint, word binary, tf bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double"
    rows = written(docs.select("doc_id", "version", "held_out", "text").mapInArrow(run, schema), "scored")

    cls = F.pmod(F.crc32(F.expr("substring(word, -3)")), F.lit(CLASSES)).cast("int")
    log_class = F.element_at(F.array(*[F.lit(float(x)) for x in class_all]), cls + 1)
    rare = rows.where("word is not null").select("doc_id", "version", "word", "tf").join(counts, "word", "left")
    c = F.log10(F.coalesce("c", F.lit(0)) + 1)
    rare = rare.select("doc_id", "version", F.lit(0).cast("long").alias("rows"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
                       F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"),
                       (F.col("tf") * (c - F.lit(float(np.log10(n + v + 1))))).alias("base"), (F.col("tf") * (c - log_class)).alias("model"))
    own = rows.where("word is null").select("doc_id", "version", F.lit(1).cast("long").alias("rows"), "held_out", "n_tokens", "n_known", "base", "model")
    total = own.unionByName(rare).groupBy("doc_id", "version").agg(
        F.sum("rows").alias("rows"), F.max("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "model")])
    # repeated rows were added up: one row for each, with its share
    each = total.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    share = lambda x: (F.col(x) / F.col("rows"))
    return each.select("doc_id", "held_out", share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"),
                       F.lit(int(n)).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("model").alias("score"))
