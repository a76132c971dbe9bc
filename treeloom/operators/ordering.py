"""Orders and limits of reports: by locale, by status, by place in a flow; and the first few of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of work items in the order of a queue; any other status comes last. Fixed values.
STATUS_RANKS = {"pending": 0, "in_flight": 0, "failed": 1, "done": 2}


def by_locale(text: Column) -> Column:
    """Sorts as people read: letters before their case, lower case first; numbers as text."""
    return F.collate(text.cast("string"), "UNICODE")


def locale_places(rows: DataFrame, by: list[str], text: str, name: str = "place") -> DataFrame:
    """Place of each row of a group by its text in the order of the locale, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(by_locale(F.col(text)))).cast("long"))


def status_rank(status: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in STATUS_RANKS.items() for x in kv])
    return F.coalesce(ranks[status], F.lit(max(STATUS_RANKS.values()) + 1))


def queue_places(items: DataFrame, by: list[str], status: str, ord_: str, name: str = "place") -> DataFrame:
    """Place of each work item of a group: open ones first, then failed, done and others, in their own order."""
    return items.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(status_rank(F.col(status)), ord_)).cast("long"))


def drafting_tasks(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """Tasks of flows, then tasks of steps, with their kind; columns that one side lacks are null."""
    return flows.withColumn("kind", F.lit("flow")).unionByName(steps.withColumn("kind", F.lit("step")), allowMissingColumns=True)


def flow_then_steps(items: DataFrame, flow: str, kind: str = "kind", step_index: str = "step_index", name: str = "place") -> DataFrame:
    """Place of each entry of a flow: the flow's own first, then its steps by index."""
    return items.withColumn(name, F.row_number().over(Window.partitionBy(flow).orderBy((F.col(kind) != "flow").cast("int"), step_index)).cast("long"))


def first_n(rows: DataFrame, order: list, n: int | None) -> DataFrame:
    """The first n rows of an order, all without a positive n."""
    return rows.orderBy(*order).limit(n) if n is not None and n > 0 else rows


def slots_needed(members: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Slots of each key: one more than its largest index."""
    return members.groupBy(*keys).agg((F.max(index) + 1).alias("slots"))
