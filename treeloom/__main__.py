"""python -m treeloom COMMAND ...: thin commands over the plans."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .operators import validate as V
from .operators.store import Store
from .plans import book, builds, convert, flows, mining, polish, render
from .sources import documents, sinks

#: Commands and their arguments.
COMMANDS = {
    "parse": ("index", "out"), "validate": ("build",), "change-log": ("old", "new", "out"), "markdown": ("build", "out"), "book": ("build", "out"), "ingest": ("build", "store"), "validation-table": ("rows", "store"),
    "convert": ("build", "out"), "convert-all": ("folder", "out"), "format-all": ("folder", "out"), "flows": ("build", "out"),
    "observe": ("build", "out"), "mine": ("build", "out"), "gaps": ("build", "out"), "facts": ("build", "out"), "enrich": ("build", "drafts", "out"),
}


def _one(spark: SparkSession, path: str) -> DataFrame:
    rows = documents.read_yaml(spark, path, "*")
    if (bad := rows.where("error is not null").first()) is not None:
        sys.exit(f"{bad.path}: {bad.error}")
    return rows.select(F.lit("x").alias("build"), "doc")


def _many(spark: SparkSession, folder: str) -> DataFrame:
    """The good builds of a folder; the others are reported."""
    rows = documents.read_builds(spark, folder)
    for r in rows.where("error is not null").toLocalIterator():
        print(f"{r.build}: {r.error}", file=sys.stderr)
    return rows.where("error is null").select("build", "doc")


def _observed(b: DataFrame) -> DataFrame:
    """Observed payload paths of a build as paths below their action."""
    return book.observe(b).where("path_key <> action").select("build", "usecase", "action", F.expr("substring(path_key, length(action) + 2)").alias("path_key"), "value_type", "samples", "n_flows", "is_leaf")


def _gaps(b: DataFrame) -> DataFrame:
    """Observed leaves of payloads whose description is missing or incomplete, with the reason."""
    seen = _observed(b).where("is_leaf").withColumn("dotted", F.concat_ws(".", "action", "path_key"))
    known = builds.leaves(builds.attribute_sets(b)).select("build", F.col("use_case").alias("usecase"), F.array_join("path", ".").alias("dotted"), "leaf")
    return polish.gaps(seen, known, ["build", "usecase", "dotted"]).where("reason <> 'complete_existing_leaf'")


def _enriched(spark: SparkSession, b: DataFrame, drafts: str) -> DataFrame:
    """Leaves of a build with the approved drafts of a JSON file (use_case, path, leaf, score) written over them."""
    leaves = builds.leaves(builds.attribute_sets(b)).select("build", "use_case", F.array_join("path", ".").alias("path"), "leaf")
    new = spark.read.json(drafts).select(F.lit("x").alias("build"), "use_case", "path", "leaf", R.approved(F.col("score")).alias("approved"))
    return polish.overlay(leaves, new, ["build", "use_case", "path"])


def _pages(b: DataFrame) -> DataFrame:
    pages = render.flow_pages(builds.flows(b)).select("file", "page")
    for name, rows in (("errors", render.error_page(builds.error_codes(b))), ("actions", render.action_page(builds.action_edges(b))), ("index", render.index_page(builds.facts(b), builds.docs(b)))):
        pages = pages.unionByName(rows.select(F.lit(name).alias("file"), "page"))
    return pages


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="treeloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("treeloom").getOrCreate()
    if a.command == "parse":
        documents.read_split(spark, a.index).select("doc").write.mode("overwrite").text(a.out)
    elif a.command == "validate":
        failed = V.run_checks(_one(spark, a.build)).where("not passed").collect()
        for r in failed:
            for i in r.issues:
                print(f"{r.check}: {i.path}: {i.message}")
        return int(bool(failed))
    elif a.command == "change-log":
        sinks.write_json(builds.section_table(builds.changelog(_one(spark, a.old), _one(spark, a.new))), a.out, gzip=True)
    elif a.command == "markdown":
        sinks.write_pages(_pages(_one(spark, a.build)), a.out)
    elif a.command == "book":
        book.book(_one(spark, a.build)).select("page").write.mode("overwrite").text(a.out)
    elif a.command == "ingest":
        print(json.dumps(Store(spark, a.store).ingest(_one(spark, a.build).select("doc"))))
    elif a.command == "validation-table":
        print(json.dumps({"actions": Store(spark, a.store).ingest_validation_table(spark.read.json(a.rows))}))
    elif a.command == "convert":
        convert.convert_build(_one(spark, a.build)).select("doc").write.mode("overwrite").text(a.out)
    elif a.command == "convert-all":
        old = _many(spark, a.folder)
        convert.convert_build(old).write.mode("overwrite").partitionBy("build").text(a.out)
        print(json.dumps({"converted": old.count()}))
    elif a.command == "format-all":
        for name, rows in flows.split_build(_many(spark, a.folder)).items():
            rows.write.mode("overwrite").json(str(Path(a.out) / name) if "://" not in a.out else f"{a.out}/{name}")
    else:
        b = _one(spark, a.build)
        if a.command == "mine":
            steps = builds.steps(builds.flows(b))
            seen = _observed(b).select("build", "action", F.split("path_key", r"\.").alias("path"), "path_key")
            rows = mining.bundles(b, steps, seen)
        elif a.command == "enrich":
            rows = _enriched(spark, b, a.drafts)
        else:
            rows = {"flows": lambda: render.flow_summary(builds.flows(b)), "observe": lambda: _observed(b), "gaps": lambda: _gaps(b), "facts": lambda: builds.facts(b)}[a.command]()
        sinks.write_json(rows, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
