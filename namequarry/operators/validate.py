"""Row validation that collects every error, and canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(rules: dict[str, Column]) -> Column:
    """The names of all rules that a row breaks, in their order. A rule is what must hold; null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def quarantined(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, other rows with their ``errors``). Both sides come from one expression, so no row is in neither or both."""
    checked = df.withColumn("errors", errors(rules))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def refused(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` unchanged, or a failed job at the first row that breaks a rule."""
    broken = errors(rules)
    return df.where(F.when(F.size(broken) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row breaks: "), F.array_join(broken, ",")))))


def canonical(text: str | None, depth: int = 64) -> str | None:
    """JSON with sorted keys and no spaces; null if it can't be read or nests deeper than ``depth``."""

    def deep(v, left: int) -> bool:
        if left < 0:
            return False
        return all(deep(x, left - 1) for x in (v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else True

    try:
        value = json.loads(text) if text is not None else None
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) if text is not None and deep(value, depth) else None
    except (ValueError, RecursionError):
        return None


def with_canonical(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical) of every row, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([canonical(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "canonical"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, canonical string")
