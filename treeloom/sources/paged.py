"""A Python data source over a paged listing: pages are partitions, read side by side.

The fetcher is any picklable function (page, size) -> list of dicts, such as a call of a REST service
or a fixture. Pages are read in waves until a short one ends the listing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_ROWS = 100


def source(name: str, fetch: Callable[[int, int], list[dict]], schema: str, size: int = PAGE_ROWS, wave: int = 8) -> type[DataSource]:
    """A data source class to register under a name."""
    fields = [x.split()[0] for x in schema.split(",")]

    class Page(InputPartition):
        def __init__(self, first: int):
            super().__init__(first)

    class Reader(DataSourceReader):
        def partitions(self):
            # One listing is read in as many strides as a wave has pages; each stride ends at its first short page.
            return [Page(k) for k in range(wave)]

        def read(self, partition):
            page = partition.value
            while True:
                rows = fetch(page, size)
                for r in rows:
                    yield tuple(r.get(f) for f in fields)
                if len(rows) < size:
                    return
                page += wave

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Paged


def read(spark: SparkSession, name: str, fetch, schema: str, size: int = PAGE_ROWS, prefix: tuple[str, str] | None = None) -> DataFrame:
    """All pages; with prefix (column, start) only matching rows."""
    spark.dataSource.register(source(name, fetch, schema, size))
    rows = spark.read.format(name).load()
    return rows.where(F.col(prefix[0]).startswith(prefix[1])) if prefix else rows


def filter_payloads(payloads: DataFrame, domain: str, version: str, flow_id: str, actions: list[str]) -> DataFrame:
    """Recorded payloads of a flow: equality, either place of the version, and a set of actions; filters reach the scan."""
    at = lambda k: F.get_json_object("json_request", f"$.context.{k}")
    wanted = sorted({a.strip().upper() for a in actions})
    return payloads.where((F.col("flow_id") == flow_id) & F.col("action").isin(wanted) & (at("domain") == domain.strip()) & ((at("core_version") == version) | (at("version") == version)))


def split_errors(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows and a dead-letter table."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())
