"""Readable reports: markdown tables, indexes and pages, one text per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordering as O
from . import builds as B


def ordered_lines(line: Column, ord_: str, separator: str = "\n") -> Column:
    """Aggregate of lines in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_), line.alias("line")))), lambda r: r["line"]), separator)


def row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[T.escape_cell(c.cast("string")) for c in cells]), F.lit(" |"))


def table(df: DataFrame, keys: list[str], columns: dict[str, Column], ord_: str, name: str = "page") -> DataFrame:
    """A markdown table per group."""
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    return df.groupBy(*keys).agg(F.concat(F.lit(head), ordered_lines(row(list(columns.values())), ord_)).alias(name))


def grouped_index(df: DataFrame, group: str, item: Column, ord_: str) -> DataFrame:
    """A heading and a list per group, with the number of items."""
    return df.groupBy(group).agg(F.concat(F.lit("## "), F.first(group), F.lit("\n"), ordered_lines(F.concat(F.lit("- "), item), ord_)).alias("section"), F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Place of each row in an order; for report-sized tables, as it sorts all rows together."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(order)).cast("long"))


def successors(df: DataFrame, group: str, order: list[str], action: str) -> DataFrame:
    """Distinct pairs of an action and the one that follows it in its group."""
    following = F.lead(action).over(Window.partitionBy(group).orderBy(*order))
    return df.select(F.col(action).alias("action"), following.alias("next")).where("next is not null").distinct()


def flow_summary(flow_table: DataFrame) -> DataFrame:
    """Flows with tags, number of steps and sequence of actions (blank actions count, but are not shown)."""
    steps = B.members(B.part(F.col("config"), "steps"))
    actions = F.filter(F.transform(steps, lambda s: F.get_json_object(s, "$.api")), lambda a: a.isNotNull() & (F.trim(a) != ""))
    return flow_table.select("build", "id", "usecase", "ord", F.array_join("tags", ", ").alias("tags"), F.size(steps).alias("n_steps"), actions.alias("actions"))


def flow_pages(flow_table: DataFrame) -> DataFrame:
    s = flow_summary(flow_table).join(flow_table.select("build", "id", "description"), ["build", "id"])
    lines = F.concat_ws("\n", F.concat(F.lit("# "), F.col("id")), F.lit(""), F.coalesce("description", F.lit("")), F.lit(""), F.concat(F.lit("Use case: "), F.col("usecase")), F.concat(F.lit("Tags: "), F.col("tags")), F.concat(F.lit("Steps: "), F.array_join("actions", " → ")))
    return s.select("build", T.hyphen_name(F.col("id")).alias("file"), lines.alias("page"))


def flows_by_usecase(flow_table: DataFrame) -> DataFrame:
    return grouped_index(flow_table.withColumn("k", F.concat_ws(" / ", "build", "usecase")), "k", F.concat(F.col("id"), F.lit(": "), F.coalesce("description", F.lit(""))), "ord")


def error_page(errors: DataFrame) -> DataFrame:
    """Error codes as a table, in the order of the locale; equal codes stay in their own order."""
    place = F.row_number().over(Window.partitionBy("build").orderBy(O.by_locale(F.col("code")), "ord"))
    return table(errors.withColumn("place", place), ["build"], {"Code": F.col("code"), "Event": F.col("Event"), "Description": F.col("Description"), "From": F.col("From")}, "place")


def action_page(edges: DataFrame) -> DataFrame:
    return table(edges, ["build"], {"Action": F.col("action"), "Next": F.array_join("next", ", ")}, "ord")


def attribute_page(leaf_table: DataFrame) -> DataFrame:
    """Leaves of each use case and action: paths here end in _description, as the page's readers expect."""
    j = lambda k: F.get_json_object("leaf", f"$.{k}")
    rows = leaf_table.withColumns({"action": F.get("path", F.lit(0)), "dotted": F.concat(F.array_join("path", "."), F.lit("._description"))})
    return table(rows, ["build", "use_case", "action"], {"Path": F.col("dotted"), "Required": j("required"), "Type": j("type"), "Owner": j("owner"), "Usage": j("usage"), "Description": j("info")}, "dotted")


def index_page(facts: DataFrame, docs: DataFrame) -> DataFrame:
    links = docs.groupBy("build").agg(ordered_lines(F.concat(F.lit("- ["), T.title_slug(F.col("slug")), F.lit("]("), F.col("slug"), F.lit(".md)")), "ord").alias("links"))
    f = facts.join(links, "build", "left")
    count = lambda n, c: F.concat(F.lit(f"- {n}: "), F.col(c).cast("string"))
    return f.select("build", F.concat_ws("\n", F.concat(F.lit("# "), F.col("domain"), F.lit(" "), F.col("version")), F.lit(""), count("Flows", "n_flows"), count("Attribute sets", "n_attribute_sets"), count("Error codes", "n_errors"), count("Actions", "n_actions"), F.lit(""), F.col("links")).alias("page"))
