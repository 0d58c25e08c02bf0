"""Registered queries of this subpackage with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import alignment as q12
from . import bpe as q1
from . import embeddings as q5
from . import fingerprint as q13
from . import html_text as q7
from . import importance as q11
from . import lm as q4
from . import minhash as q3
from . import packing as q2
from . import quality as q6
from . import suffixes as q10
from . import token_counts as q9
from . import units as q8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_STOPS = ", ".join("'" + w + "'" for w in sorted({w for ws in q6.STOP_WORDS.values() for w in ws}))
_OP6_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM t),
g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) AS g FROM s),
u AS (SELECT row_number() OVER () AS r, * FROM g),
x AS (SELECT r, unnest(g) AS win, unnest(range(len(g))) AS p FROM u WHERE len(g) > 0),
d AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS c FROM x) WHERE c > 1),
e AS (SELECT r, count(DISTINCT p + k) AS n_rep FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT u.doc_id, len(w) AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
             len(regexp_extract_all(t, '\p{{Lu}}{{2,}}')) AS n_upper,
             len(list_filter(l, lambda z: ends_with(z, '...') OR ends_with(z, chr(8230)))) AS n_ellipsis,
             len(list_filter(l, lambda z: regexp_matches(z, '^[-*\x{{2022}}]'))) AS n_bullets,
             len(list_filter(w, lambda z: z IN ({_STOPS}))) AS n_stops
      FROM u LEFT JOIN e USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             greatest(n_words, 1)::DOUBLE AS n, greatest(n_lines, 1)::DOUBLE AS k FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 50 AND word_chars / n >= 2.0 AND word_chars / n <= 15.0 AND n_symbols / n <= 0.10
       AND n_upper / n <= 0.30 AND n_repeat_words / n <= 0.50 AND n_dup_lines / k <= 0.50
       AND n_ellipsis / k <= 0.30 AND n_bullets / k <= 0.90 AND n_stops / n >= 0.02 AS kept,
       n_lines, n_symbols / n AS symbol_word_ratio, n_upper / n AS upper_word_ratio, n_dup_lines / k AS dup_line_ratio,
       n_stops / n AS stop_word_ratio
FROM f
"""


@_query("op6_quality_rules", _OP6_SQL)
def op6(spark, sf_dir):
    return q6.quality_rules(_documents(spark, sf_dir))


#: Vocabulary files are read where they lie; the folder is that of the installed package.
BYTE_RANKS, BYTE_JSON, WORD_JSON, PIECE_MODEL = (public_tokenizers.path(n) for n in (
    "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@_query("op1_byte_bpe")
def op1(spark, sf_dir):
    return q1.round_trip(_documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


@_query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return q2.packed(_documents(spark, sf_dir), WORD_JSON)


@_query("op9_token_counts")
def op9(spark, sf_dir):
    return q9.token_counts(_documents(spark, sf_dir), BYTE_JSON, public_tokenizers.PATTERN, limit=512)


@_query("op7_main_text")
def op7(spark, sf_dir):
    return q7.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS u FROM d),
x AS (SELECT doc_id, t, unnest(u) AS x, unnest(range(len(u))) AS k FROM p),
s AS (SELECT doc_id, t, x, k, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY k
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a,
             list_filter(string_split_regex(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws FROM x),
r AS (SELECT *, len(ws) >= 3 AND row_number() OVER (PARTITION BY ws ORDER BY doc_id, k) > 1 AS gone FROM s)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
       coalesce(sum(length(x)) FILTER (gone), 0)::BIGINT AS removed_chars,
       coalesce(string_agg(a || '-' || (a + length(x)), ',' ORDER BY k) FILTER (gone), '') AS spans,
       sha256(coalesce(string_agg(substr(t, a + 1, length(x) + 1), '' ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


@_query("op8_unit_dedup", _OP8_SQL)
def op8(spark, sf_dir):
    out = q8.deduplicated(_documents(spark, sf_dir))
    return out.select("doc_id", "n_units", "n_removed", "removed_chars", "spans", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op3_minhash_dedup")
def op3(spark, sf_dir):
    return q3.near_duplicates(_documents(spark, sf_dir))


@_query("op10_suffix_dedup")
def op10(spark, sf_dir):
    out = q10.without_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op5_embedding_dedup")
def op5(spark, sf_dir):
    return q5.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query("op4_lm_scores")
def op4(spark, sf_dir):
    return q4.scores(_documents(spark, sf_dir))


@_query("op11_importance_resampling")
def op11(spark, sf_dir):
    return q11.resampled(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query("op12_token_alignment")
def op12(spark, sf_dir):
    return q12.aligned(_documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN, PIECE_MODEL)


@_query("op13_fingerprints")
def op13(spark, sf_dir):
    return q13.compared(_documents(spark, sf_dir))
