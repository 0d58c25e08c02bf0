"""Quality rules (operator 6): a threshold table compiled into one Spark projection.

Every measure is a DataFrame expression over one row; there is no shuffle and no user
function.  Null and empty texts have zero words and fail; repeated rows are judged alike;
an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, and characters counted as symbols.
SPACE_RUN = r"[ \t\n\x0B\f\r]+"
NOT_SPACE = r"[^ \t\n\x0B\f\r]"
SYMBOL = "[#*$%&|<>]"

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to a in is it that for on with as was by this be are from or an at not have he".split(),
    "fr": "le la les de des du et un une en que qui pour dans par sur est au avec pas ne se".split(),
    "de": "der die das und ist in ein eine zu den von mit nicht auf für sich dem des im es auch als".split(),
    "es": "el la los las de del y en un una que por con para se no es al su como esta".split(),
}

#: measure, comparison that a kept text meets, threshold.  Ratios are per word or per line.
RULES = (
    ("n_words", ">=", 50),
    ("mean_word_chars", ">=", 2.0),
    ("mean_word_chars", "<=", 15.0),
    ("symbol_word_ratio", "<=", 0.10),
    ("upper_word_ratio", "<=", 0.30),
    ("repeat_word_ratio", "<=", 0.50),
    ("dup_line_ratio", "<=", 0.50),
    ("ellipsis_line_ratio", "<=", 0.30),
    ("bullet_line_ratio", "<=", 0.90),
    ("stop_word_ratio", ">=", 0.02),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (bound as a lambda variable), so that an
    array is never rebuilt for each element of an inner function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def lines(text: Column) -> Column:
    """``\\n``-separated lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))


def windows(ws: Column) -> Column:
    """A 64-bit digest of each three-word window of an array of at least four words."""
    return F.transform(F.sequence(F.lit(0), F.size(ws) - 3),
                       lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))


def covered(ws: Column) -> Column:
    """Number of words inside windows whose digest occurs at least twice: digests are sorted
    with their positions, equal neighbours mark both, marked positions count once."""
    def marked(s: Column) -> Column:
        last = F.size(s) - 1
        hit = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                       | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(
            hit, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    return _let(F.array_sort(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), marked)


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row with the counts that the rules use (and the text as ``t``)."""
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    text = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    split = text.select("doc_id", "t", words(F.col("t")).alias("w"), lines(F.col("t")).alias("l"))
    t, w, ln = F.col("t"), F.col("w"), F.col("l")
    hashed = split.select("*", F.when(F.size(w) > 3, windows(w)).alias("g"))
    g = F.col("g")
    return hashed.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size(ln).cast("long").alias("n_lines"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        # a later filter on the counts must not be moved below the projections that build the
        # arrays (they would be rebuilt for each element); it is not, past a row number
        F.when((F.monotonically_increasing_id() < 0) | g.isNull() | (F.size(F.array_distinct(g)) == F.size(g)), F.lit(0))
        .otherwise(covered(g)).cast("long").alias("n_repeat_words"),
        F.regexp_count(t, F.lit(r"\p{Lu}{2,}")).cast("long").alias("n_upper"),
        F.size(F.filter(ln, lambda x: x.endswith("...") | x.endswith("\u2026"))).cast("long").alias("n_ellipsis"),
        F.size(F.filter(ln, lambda x: x.rlike("^[-*\u2022]"))).cast("long").alias("n_bullets"),
        F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stops"),
        *([t] if with_text else []),
    )


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression over the ratio columns."""
    ok = F.lit(True)
    for name, op, bound in rules:
        c = F.col(name)
        ok = ok & (c >= F.lit(bound) if op == ">=" else c <= F.lit(bound))
    return F.coalesce(ok, F.lit(False))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, with_text: bool = False) -> DataFrame:
    """Counts, ratios and the verdict per row (and the text as ``t``).  ``base_failed``: under 50 words,
    or over half of the words in repeated three-word windows; ``kept``: not that, and every rule holds."""
    m = measures(df, id_col, text_col, with_text)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    k = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    ratios = m.select(
        "*", (F.col("word_chars") / n).alias("mean_word_chars"), (F.col("n_symbols") / n).alias("symbol_word_ratio"),
        (F.col("n_upper") / n).alias("upper_word_ratio"), (F.col("n_repeat_words") / n).alias("repeat_word_ratio"),
        (F.col("n_stops") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / k).alias("dup_line_ratio"), (F.col("n_ellipsis") / k).alias("ellipsis_line_ratio"),
        (F.col("n_bullets") / k).alias("bullet_line_ratio"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return ratios.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"), "n_lines", "symbol_word_ratio", "upper_word_ratio",
        "dup_line_ratio", "stop_word_ratio", *(["t"] if with_text else []))


def good_rows(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df``, all columns, whose text the rules keep (never a null one).  The text passes
    through once, beside the other columns."""
    others = [c for c in df.columns if c != text_col]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row")
    kept = quality_rules(df.select(row, F.col(f"`{text_col}`").alias("text")), "row", "text", rules, True).where("kept")
    return kept.select(*[F.col("t").alias(c) if c == text_col else F.col("doc_id").getField(c).alias(c) for c in df.columns])
