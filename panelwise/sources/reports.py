"""Device-report JSON lines -> one flat reading per report (SRC5, SRC6).

Row-local: each attribute column is picked from the report's ``smart_table`` array with
``filter`` + ``element_at(-1)`` (last occurrence wins), so flattening needs no shuffle.
Malformed lines are kept apart with their text (PERMISSIVE parsing), never dropped
silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attribute ids kept from a report; each maps to column smart_{id}_raw.
ATTRIBUTE_IDS = (1, 3, 4, 5, 7, 9, 10, 12, 187, 188, 194, 197, 198, 199, 201, 240, 241, 242)
UNKNOWN = "UNKNOWN"
CORRUPT = "_corrupt_record"

REPORT_SCHEMA = T.StructType([
    T.StructField("serial_number", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("user_capacity", T.StructType([T.StructField("bytes", T.LongType())])),
    T.StructField("smart_table", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("raw", T.StructType([T.StructField("value", T.LongType())])),
    ]))),
    T.StructField(CORRUPT, T.StringType()),
])


def attribute_column(attr_id: int) -> str:
    return f"smart_{attr_id}_raw"


def _attr(table: Column, attr_id: int) -> Column:
    hit = F.try_element_at(F.filter(table, lambda a: a["id"] == F.lit(attr_id)), F.lit(-1))
    return F.when(hit.isNotNull(), F.coalesce(hit["raw"]["value"], F.lit(0)).cast("double"))


def parse_reports(lines: DataFrame, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parse JSON report lines; returns ``(readings, rejected)``.

    readings: serial_number, timestamp, model, capacity_bytes, smart_{id}_raw for every
    kept id (NULL when the report has no entry; an entry without raw value gives 0);
    ids outside ``ATTRIBUTE_IDS`` vanish.  rejected: the raw text of lines that are not
    a JSON object.
    """
    parsed = lines.select(F.col(text_col).alias("_line"),
                          F.from_json(text_col, REPORT_SCHEMA,
                                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    rejected = parsed.filter(bad).select(F.col("_line").alias("line"))
    good = parsed.filter(~bad)
    table = F.col("r.smart_table")
    readings = good.select(
        F.coalesce(F.col("r.serial_number"), F.lit(UNKNOWN)).alias("serial_number"),
        F.col("r.timestamp").alias("timestamp"),
        F.coalesce(F.col("r.model_name"), F.lit(UNKNOWN)).alias("model"),
        F.coalesce(F.col("r.user_capacity.bytes"), F.lit(0)).cast("long").alias("capacity_bytes"),
        *[_attr(table, i).alias(attribute_column(i)) for i in ATTRIBUTE_IDS])
    return readings, rejected


def read_reports(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Reports stored as JSON lines (one report per line)."""
    return parse_reports(spark.read.text(path))


def to_reports(df: DataFrame, id_columns: dict[int, Column], key: str = "serial_number",
               time: str = "timestamp") -> DataFrame:
    """Build report lines from a panel: each ``id -> expr`` becomes a ``smart_table``
    entry, left out when the value is NULL (FIXTURES P4)."""
    entries = [F.when(expr.isNotNull(), F.struct(F.lit(i).alias("id"),
                                                 F.struct(expr.cast("long").alias("value")).alias("raw")))
               for i, expr in id_columns.items()]
    table = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.select(F.to_json(F.struct(F.col(key).alias("serial_number"), F.col(time).alias("timestamp"),
                                        table.alias("smart_table"))).alias("value"))
