"""Sources and sinks over files: strict JSON tables, recorded pages, versioned stores."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from namequarry.session import Files


class BadRows(ValueError):
    """A strict source holds rows that don't fit its schema."""


def strict_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """Rows of a JSON file under an explicit schema; one row that doesn't fit refuses the whole file."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    df = spark.read.schema(wide).option("columnNameOfCorruptRecord", "_bad").option("multiLine", multiline).json(path)
    checked = df.withColumn("_ok", F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("row doesn't fit: "), F.substring("_bad", 1, 80)))).otherwise(True))
    return checked.where("_ok").select(*schema.fieldNames())


def lenient_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that fit; others are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bounded_files(spark: SparkSession, path: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(within, beyond): files with their text up to ``most`` bytes, and the paths and sizes of larger ones. Sizes come from the listing, so large files aren't read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most).select("path", F.decode("content", "UTF-8").alias("text"))
    return small, files.where(F.col("length") > most).select("path", "length")


class _Rows(HTMLParser):
    """The cells of every table row of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.cell = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = False

    def handle_data(self, data):
        if self.cell and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page, row_no, cells array<string>) of every table row of recorded pages; malformed markup gives what can be read, pages without tables nothing."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                reader = _Rows()
                reader.feed(text or "")
                out += [(page, i, [c.strip() for c in cells]) for i, cells in enumerate(reader.rows)]
            yield pd.DataFrame(out, columns=["page", "row_no", "cells"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(parse, f"page {kind}, row_no int, cells array<string>")


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["pages"])

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in self.paths]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for attempt in range(3):
            try:
                with open(partition.path, encoding="utf-8") as f:
                    body = json.load(f)
                break
            except OSError:
                if attempt == 2:
                    raise
        for row in body.get("rows", []):
            yield (partition.path, json.dumps(row, sort_keys=True))


class RecordedPages(DataSource):
    """``spark.read.format("recorded_pages").option("pages", json list of paths)``: rows of recorded API pages, one partition a page."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "page string, row string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class VersionedTable:
    """A Parquet table whose versions are swapped by one small file: readers see all of a version or none of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)

    def version(self) -> int:
        at = f"{self.path}/current"
        return int(self.files.read(at)) if self.files.exists(at) else -1

    def save(self, df: DataFrame) -> int:
        n = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={n:06d}")
        self.files.put(f"{self.path}/current", str(n))
        return n

    def load(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version():06d}")
