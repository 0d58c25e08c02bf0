"""Append with rollback (SNK3): batches are staged, and a manifest says which of them count.

A store is a folder with ``data/`` (one folder for each staged batch, partitioned by year and month)
and ``manifest/`` (one small JSON file for each version: the batches that count, in order).  A
batch counts from the moment its version is renamed into place, and the rename fails where that
version is there already: writers that meet try again on top of the other's version.  So a failed
append leaves nothing that readers see, a repeated one (same batch name) changes nothing, and a
rollback is a new version with the older list.  Readers take the newest version once and are not
disturbed by later ones.

The manifest grows by one line a batch; ``compact`` replaces the batches by one.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..spec import PanelSpec
from . import write_partitioned


class Conflict(RuntimeError):
    """Another writer has committed the version in between."""


def _fs(spark: SparkSession, root: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path.getFileSystem(conf), conf


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first (a listing of the manifest folder)."""
    jvm, fs, _ = _fs(spark, root)
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(m[1]) for m in map(re.compile(r"v(\d{8})\.json").fullmatch, names) if m)


def batches(spark: SparkSession, root: str, version: int | None = None) -> list[dict]:
    """The batches of a version (default: the newest): name, folder, schema."""
    found = versions(spark, root)
    if not found or version == 0:
        return []
    version = found[-1] if version is None else version
    jvm, fs, _ = _fs(spark, root)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/v{version:08d}.json"))
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _commit(spark: SparkSession, root: str, version: int, rows: list[dict]) -> None:
    jvm, fs, conf = _fs(spark, root)
    hadoop = jvm.org.apache.hadoop.fs
    path = lambda p: hadoop.Path(p)
    own = path(f"{root}/manifest/.staged-{uuid.uuid4().hex}")
    fs.mkdirs(path(f"{root}/manifest"))
    out = fs.create(own, False)
    try:
        out.write(bytearray(json.dumps(rows).encode()))
    finally:
        out.close()
    target = path(f"{root}/manifest/v{version:08d}.json")
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:  # without the overwrite option the rename fails where the target exists
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(own), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(own, False)
        if fs.exists(target):
            raise Conflict(f"version {version} of {root} is there already") from e
        raise


def _change(spark: SparkSession, root: str, change: Callable[[list[dict]], list[dict] | None], tries: int = 20) -> int:
    """Commit ``change(batches)`` as the next version; None commits nothing.  Returns the version that counts."""
    for _ in range(tries):
        found = versions(spark, root)
        last = found[-1] if found else 0
        rows = change(batches(spark, root, last))
        if rows is None:
            return last
        try:
            _commit(spark, root, last + 1, rows)
            return last + 1
        except Conflict:
            continue
    raise Conflict(f"{root}: gave up after {tries} tries")


def stage(df: DataFrame, root: str, spec: PanelSpec) -> dict:
    """Write a batch beside the store; nobody sees it before it is committed."""
    folder = f"data/staged={uuid.uuid4().hex}"
    write_partitioned(df, f"{root}/{folder}", spec, mode="errorifexists", dynamic=False)
    return {"folder": folder, "schema": json.loads(df.schema.json())}


def append(df: DataFrame, root: str, spec: PanelSpec, batch: str) -> int:
    """Append a named batch, once: a name that counts already is not written again."""
    spark = df.sparkSession
    if any(b["batch"] == batch for b in batches(spark, root)):
        return versions(spark, root)[-1]
    entry = {"batch": batch, **stage(df, root, spec)}
    return _change(spark, root, lambda rows: None if any(b["batch"] == batch for b in rows) else [*rows, entry])


def rollback(spark: SparkSession, root: str, version: int) -> int:
    """A new version with the batches of an older one (0: none)."""
    if version and version not in versions(spark, root):
        raise ValueError(f"{root} has no version {version}")
    old = batches(spark, root, version)
    return _change(spark, root, lambda rows: old)


def read(spark: SparkSession, root: str, schema: T.StructType | None = None, version: int | None = None) -> DataFrame:
    """All rows of the batches that count, with ``year`` and ``month``; columns that a batch lacks are
    null.  A store without batches needs ``schema``."""
    rows = batches(spark, root, version)
    if not rows:
        if schema is None:
            raise ValueError(f"{root} has no batches; give a schema")
        return spark.createDataFrame([], schema)
    groups: dict[str, list[dict]] = {}
    for b in rows:
        groups.setdefault(json.dumps(b["schema"], sort_keys=True), []).append(b)
    out = None
    for same in groups.values():
        fields = T.StructType.fromJson(same[0]["schema"])
        full = T.StructType([*[f for f in fields if f.name not in ("year", "month")],
                             T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
                             T.StructField("staged", T.StringType())])
        part = spark.read.schema(full).option("basePath", f"{root}/data").parquet(*dict.fromkeys(f"{root}/{b['folder']}" for b in same)).drop("staged")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def compact(spark: SparkSession, root: str, spec: PanelSpec) -> int:
    """One batch in place of all that count now (their names still count as appended)."""
    rows = batches(spark, root)
    if len(rows) < 2:
        return versions(spark, root)[-1] if rows else 0
    whole = read(spark, root)
    staged = stage(whole.drop("year", "month"), root, spec)
    gone = {b["folder"] for b in rows}

    def change(now: list[dict]) -> list[dict] | None:
        if not gone <= {b["folder"] for b in now}:
            return None  # rolled back meanwhile
        names = [{"batch": b["batch"], **staged} for b in now if b["folder"] in gone]
        return [*names, *[b for b in now if b["folder"] not in gone]]

    return _change(spark, root, change)


def staged_only(spark: SparkSession, root: str) -> list[str]:
    """Folders that no version names (failed appends, or appends under way): a report, nothing is deleted."""
    jvm, fs, _ = _fs(spark, root)
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    if not fs.exists(folder):
        return []
    named = {b["folder"] for v in versions(spark, root) for b in batches(spark, root, v)}
    return sorted(f for f in (f"data/{s.getPath().getName()}" for s in fs.listStatus(folder)) if f not in named)
