"""Scans of specification files: YAML, JSON, Markdown folders, partitioned trees and split documents."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T

_SCALARS = (str, int, float, bool, type(None))


def _plain(value):
    """YAML's dates and odd keys as JSON can hold them."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if isinstance(value, _SCALARS) else str(value)


@F.pandas_udf(StructType([StructField("doc", StringType()), StructField("error", StringType())]))
def _yaml_to_json(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for batch in texts:
        out = []
        for t in batch:
            try:
                out.append((json.dumps(_plain(yaml.load(t, Loader=loader)), ensure_ascii=False), None) if t is not None else (None, "no text"))
            except yaml.YAMLError as e:
                out.append((None, str(e)[:500]))
        yield pd.DataFrame(out, columns=["doc", "error"])


def read_texts(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, text: whole files."""
    r = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_yaml(spark: SparkSession, path: str, glob: str = "*.y*ml", recursive: bool = False) -> DataFrame:
    """path, doc (JSON text), error; a file that can't be parsed keeps its error and has no doc."""
    return read_texts(spark, path, glob, recursive).withColumn("p", _yaml_to_json("text")).select("path", "p.doc", "p.error")


def read_builds(spark: SparkSession, base: str, name: str = "build.yaml") -> DataFrame:
    """<base>/<domain>/<version>/<name>: build, domain, version, doc, error. Folders without the file have no row."""
    rows = read_yaml(spark, base, name, recursive=True)
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    return rows.select(F.concat_ws("/", part(3), part(2)).alias("build"), part(3).alias("domain"), part(2).alias("version"), "doc", "error")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """slug, content of the .md files of a folder."""
    return read_texts(spark, folder, "*.md").select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slug"), F.col("text").alias("content"))


def leaf_folders(files: DataFrame, base: str, names: tuple = ("flow.json", "payloads.json")) -> DataFrame:
    """Folders that hold one of the files, without those below another such folder; id is the path under base joined by `_`."""
    rel = F.regexp_replace("path", "^(file:)?/*" + base.replace("file:", "").strip("/") + "/?", "")
    rows = files.where(F.element_at(F.split("path", "/"), -1).isin(*names)).select(F.regexp_replace(rel, "/?[^/]+$", "").alias("folder")).distinct()
    above = rows.select(F.col("folder").alias("above"))
    up = rows.withColumn("ups", T.proper_prefixes(F.split("folder", "/"))).select("folder", F.explode("ups").alias("u")).select("folder", F.array_join("u", "/").alias("above"))
    nested = up.join(above, "above", "left_semi").select("folder").distinct()
    return rows.join(nested, "folder", "left_anti").select("folder", F.replace("folder", F.lit("/"), F.lit("_")).alias("id"))


def pointer(doc: Column, path: str) -> Column:
    """JSON pointer; a target that is missing is an error."""
    steps = [p.replace("~1", "/").replace("~0", "~") for p in path.lstrip("#").split("/") if p]
    at = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps)
    found = F.try_variant_get(F.parse_json(doc), at, "variant")
    return F.coalesce(F.to_json(found), F.raise_error(F.lit(f"nothing at {path}")).cast("string"))


def is_pure_ref(doc: Column) -> Column:
    """True for an object whose only key is $ref."""
    keys = F.json_object_keys(doc)
    return F.coalesce((F.size(keys) == 1) & (F.get(keys, F.lit(0)) == "$ref"), F.lit(False))


class RefError(ValueError):
    pass


def resolve(read, root: str, most_depth: int = 64):
    """A split document as one value. `read(path)` gives a parsed file, or a dict for a folder of Markdown.

    A reference is a file, a pointer in a file, or a folder. A list of references is flattened by
    one level, its results not resolved again. Below `paths` and `components` references stay.
    Works on the driver: a split document is a handful of small files.
    """

    def follow(ref: str, base: str):
        file, _, at = ref.partition("#")
        path = _join(base, file) if file else base
        value = read(path)
        for step in [s.replace("~1", "/").replace("~0", "~") for s in at.split("/") if s]:
            try:
                value = value[int(step)] if isinstance(value, list) else value[step]
            except (KeyError, IndexError, ValueError, TypeError):
                raise RefError(f"{ref}: nothing at {step}") from None
        return value, path

    def walk(value, base: str, depth: int):
        if depth > most_depth:
            raise RefError("references go round")
        if isinstance(value, dict):
            if set(value) == {"$ref"} and isinstance(value["$ref"], str):
                found, path = follow(value["$ref"], base)
                return walk(found, path, depth + 1)
            return {k: v if k in ("paths", "components") and not (isinstance(v, dict) and set(v) == {"$ref"}) else walk(v, base, depth) for k, v in value.items()}
        if isinstance(value, list):
            out = []
            for item in value:
                if isinstance(item, dict) and set(item) == {"$ref"}:
                    found = follow(item["$ref"], base)[0]
                    out.extend(found) if isinstance(found, list) else out.append(walk(found, base, depth + 1))
                else:
                    out.append(walk(item, base, depth))
            return out
        return value

    return walk(read(root), root, 0)


def _bare(path: str) -> str:
    """A path without the scheme of local files."""
    return re.sub(r"^file:/*", "/", path)


def _join(base: str, file: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), file))


def read_split(spark: SparkSession, index: str) -> DataFrame:
    """One build (build, doc) from an index file and what it refers to."""
    root = index.rsplit("/", 1)[0]
    files = {_bare(r.path): json.loads(r.doc) for r in read_yaml(spark, root, recursive=True).where("error is null").toLocalIterator()}
    texts = {_bare(r.path): r.text for r in read_texts(spark, root, "*.md", recursive=True).toLocalIterator()}

    def read(path: str):
        if path in files:
            return files[path]
        found = {k.rsplit("/", 1)[1][:-3]: v for k, v in sorted(texts.items()) if k.rsplit("/", 1)[0] == path.rstrip("/")}
        if not found:
            raise RefError(f"no file {path}")
        return found

    doc = resolve(read, _bare(index))
    return spark.createDataFrame([(index, json.dumps(doc, ensure_ascii=False))], "build string, doc string")


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge base file, an object of key to text or {info}: key, info. Old text values count as info."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e"))
    return rows.select(F.col("e.key").alias("key"), F.coalesce(F.get_json_object("e.value", "$.info"), F.when(~F.col("e.value").startswith("{"), F.col("e.value"))).alias("info"))


def with_metadata(flows: DataFrame, metadata: DataFrame, key: str, defaults: dict[str, Column], json: str | None = None) -> DataFrame:
    """Metadata beside flows, defaults where it is missing. With `json` the metadata are a column of JSON text of that name; broken text has no fields, so that the defaults hold."""
    joined = flows.join(metadata, key, "left")
    if json is None:
        return joined.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()})
    whole = F.try_parse_json(F.col(json))
    return joined.withColumns({k: F.coalesce(F.try_variant_get(whole, f"$.{k}", "string"), v) for k, v in defaults.items()}).drop(json)


def catalogue(spark: SparkSession, doc: Column | None, rows: DataFrame) -> DataFrame:
    """A domain catalogue (JSON: domains, versions, use cases) as a row per domain, version and use case."""
    shape = "array<struct<key:string,version:array<struct<key:string,usecase:array<string>>>>>"
    d = rows.select(F.explode(F.from_json(doc, shape)).alias("d")).select(F.col("d.key").alias("domain"), F.explode_outer("d.version").alias("v"))
    return d.select("domain", F.col("v.key").alias("version"), F.explode_outer("v.usecase").alias("usecase"))
