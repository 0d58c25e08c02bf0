"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from typing import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import shared_dir, written  # noqa: F401

# functions that run in Python workers are shipped by value: workers may lack this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ASCII white space, the separators of a "word" (fixed values).
ASCII_SPACE = " \t\n\x0b\x0c\r"
MASK64 = (1 << 64) - 1


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker (tasks reuse workers, so a
    vocabulary file is read once a worker and not once a task)."""
    m = sys.modules.get("_panelwise_llm_cache")
    if m is None:
        m = sys.modules["_panelwise_llm_cache"] = types.ModuleType("_panelwise_llm_cache")
        m.data = {}
    return m.data


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, A-Z lowered (bytes.split without an
    argument separates at exactly these six characters; bytes.lower changes A-Z only)."""
    return data.lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BoundedMemo(dict):
    """``memo[key]`` computes and keeps ``fn(key)``.  At most ``limit`` keys are held, in two
    generations: when the new one is full the old one goes, and keys met again come over from
    it, so frequent ones stay and memory is bounded on any vocabulary (results do not depend on it)."""

    def __init__(self, fn: Callable, limit: int = 500_000, longest: int = 64):
        super().__init__()
        self._fn, self._limit, self._longest, self._old = fn, max(1, limit // 2), longest, {}

    def __missing__(self, key):
        out = self._old.get(key)
        if out is None:
            out = self._fn(key)
        self.keep(key, out)
        return out

    def known(self, key):
        """The value, or None where it would have to be computed."""
        out = self.get(key)
        if out is None:
            out = self._old.get(key)
            if out is not None:
                self.keep(key, out)
        return out

    def keep(self, key, value) -> None:
        if len(key) <= self._longest:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[key] = value


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, size: float = 8e6) -> DataFrame:
    """``mapInArrow``: ``fn`` gets slices of a batch of about ``size`` bytes of input and returns
    {name: list, numpy array or Arrow array} or None."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                out = fn(batch.slice(i, step))
                if out is not None:
                    cols = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f in target for c in [out[f.name]]]
                    yield pa.RecordBatch.from_arrays(cols, schema=target)

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """``map_batches`` with plain columns: ``fn`` gets {name: list}."""
    return map_batches(df, lambda part: fn({n: part.column(n).to_pylist() for n in part.schema.names}), schema)


def text_rows(df: DataFrame, id_col: str, text_col: str, out_id: str, out_text: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so extra columns never clash."""
    return df.select(F.col(f"`{id_col}`").alias(out_id),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(out_text))
