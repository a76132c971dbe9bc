"""Sinks: JSON, TSV, text per row, partitioned and compressed files, and an append-only log."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


@F.pandas_udf(StringType())
def _as_yaml(docs: pd.Series) -> pd.Series:
    import yaml

    return docs.map(lambda d: None if d is None else yaml.safe_dump(json.loads(d), sort_keys=False, allow_unicode=True, width=4096))


def write_yaml(df: DataFrame, path: str, file: str = "build", doc: str = "doc") -> None:
    """A folder per file name with the JSON document as YAML."""
    write_pages(df.select(file, _as_yaml(F.col(doc)).alias("page")), path, file, "page")


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def append_timings(df: DataFrame, path: str) -> None:
    write_tsv(df, path, "append")


def write_pages(df: DataFrame, path: str, file: str = "file", page: str = "page") -> None:
    """A folder per file name with the page as text; every section of a build is one such write."""
    df.select(F.col(file), F.col(page).alias("value")).write.mode("overwrite").partitionBy(file).option("lineSep", "\n").text(path)


def write_routed(df: DataFrame, path: str, by: tuple = ("domain", "version")) -> None:
    """Documents routed by their content."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def prompt_manifest(groups: DataFrame, prompt: str) -> DataFrame:
    """A row per group: file, signature, path, action, members, length of the prompt."""
    return groups.select(F.concat(F.col("signature"), F.lit(".md")).alias("file"), "signature", "path", "action", "members", F.length(prompt).alias("prompt_chars"))
