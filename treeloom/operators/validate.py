"""Checks over builds: each gives a table of violations, and a pipeline reports what passed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import builds as B


@dataclass(frozen=True)
class Check:
    """`run` takes builds (build, doc) and returns violations (build, path, message)."""

    name: str
    description: str
    run: Callable[[DataFrame], DataFrame]


def undeclared_usecases(builds: DataFrame) -> DataFrame:
    """Use cases of flows and attribute sets that the info block doesn't declare; a set without an id is allowed."""
    declared = builds.select("build", F.explode(B.members(B.part(F.col("doc"), "info", "x-usecases"))).alias("usecase"))
    flow = B.flows(builds).select("build", "usecase", F.concat(F.lit("x-flows["), F.col("ord"), F.lit("].usecase")).alias("path"))
    sets = B.attribute_sets(builds).select("build", F.get_json_object("meta", "$.use_case_id").alias("usecase"), F.concat(F.lit("x-attributes["), F.col("ord"), F.lit("].meta.use_case_id")).alias("path")).where("usecase is not null")
    used = flow.unionByName(sets)
    return used.join(declared, ["build", "usecase"], "left_anti").select("build", "path", F.concat(F.lit('use case "'), F.coalesce("usecase", F.lit("")), F.lit('" is not declared in info.x-usecases')).alias("message"))


def schema_violations(builds: DataFrame) -> DataFrame:
    """Required keys and shapes of the envelope."""
    d = F.col("doc")
    kind = lambda *k: F.schema_of_variant(F.try_parse_json(B.part(d, *k)))
    say = lambda test, path, message: F.when(test, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    array = lambda *k: F.coalesce(~kind(*k).startswith("ARRAY"), F.lit(True))
    missing = lambda *k: B.part(d, *k).isNull()
    tests = F.array(
        say(F.try_parse_json(d).isNull(), "", "not JSON"),
        say(F.coalesce(~B.part(d, "openapi").rlike(r"^3\.\d+\.\d+$"), F.lit(True)), "openapi", "must be a 3.x.y version"),
        say(missing("info", "domain"), "info.domain", "required"), say(missing("info", "version"), "info.version", "required"),
        say(array("info", "x-usecases"), "info.x-usecases", "must be an array"), say(array("x-flows"), "x-flows", "must be an array"),
        say(array("x-attributes"), "x-attributes", "must be an array"), say(array("x-errorcodes", "code"), "x-errorcodes.code", "must be an array"),
        say(missing("x-supported-actions", "supportedActions"), "x-supported-actions.supportedActions", "required"),
    )
    top = builds.select("build", F.explode(F.array_compact(tests)).alias("v")).select("build", "v.path", "v.message")
    flow = B.flows(builds)
    need = F.array(*[F.when(F.col(k).isNull(), F.struct(F.concat(F.lit("x-flows["), F.col("ord"), F.lit(f"].{k}")).alias("path"), F.lit("required").alias("message"))) for k in ("id", "usecase", "type", "description")])
    return top.unionByName(flow.select("build", F.explode(F.array_compact(need)).alias("v")).select("build", "v.path", "v.message"))


def flow_config_problems(builds: DataFrame, usable: Callable[[Column], Column] | None = None) -> DataFrame:
    """Flows whose configuration can't run, one violation each, with the flow's place, id and use case in the path.

    `usable` gives the message for a configuration as JSON text, or null where it is fine. The runner's own rules aren't
    part of this engine; by default a configuration must be an object with an array of steps that each name their api.
    """
    flow = B.flows(builds)
    message = (usable or _config_message)(F.col("config"))
    where = F.format_string('x-flows[%d] (id: "%s", usecase: "%s")', "ord", F.coalesce("id", F.lit("")), F.coalesce("usecase", F.lit("")))
    return flow.select("build", where.alias("path"), message.alias("message")).where("message is not null")


def _config_message(config: Column) -> Column:
    kind = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit(""))
    steps = F.get_json_object(config, "$.steps")
    nameless = F.array_position(F.transform(B.members(steps), lambda s: F.coalesce(F.trim(F.get_json_object(s, "$.api")), F.lit("")) == ""), True)
    return (
        F.when(~kind(config).startswith("OBJECT"), "config must be an object").when(~kind(steps).startswith("ARRAY"), "config.steps must be an array")
        .when(nameless > 0, F.concat(F.lit("config.steps["), (nameless - 1).cast("string"), F.lit("].api is missing")))
    )


CHECKS = [
    Check("schema", "required keys and shapes", schema_violations),
    Check("usecases", "use cases of flows and attributes are declared", undeclared_usecases),
    Check("flow-configs", "configurations of flows can run", flow_config_problems),
]


def run_checks(builds: DataFrame, checks: list[Check] | None = None) -> DataFrame:
    """A row per check and build: passed, n_issues, issues (path, message)."""
    out = None
    for c in checks if checks is not None else CHECKS:
        found = c.run(builds).groupBy("build").agg(F.array_sort(F.collect_list(F.struct("path", "message"))).alias("issues"))
        rows = builds.select("build").join(found, "build", "left").select("build", F.lit(c.name).alias("check"), F.lit(c.description).alias("description"), F.coalesce(F.size("issues"), F.lit(0)).alias("n_issues"), "issues")
        rows = rows.withColumn("n_issues", F.greatest("n_issues", F.lit(0))).withColumn("passed", F.col("n_issues") == 0)
        out = rows if out is None else out.unionByName(rows)
    return out


def missing_references(rows: DataFrame, key: str, declared: DataFrame, declared_key: str) -> DataFrame:
    """Rows that refer to what isn't declared; null refers to nothing and is allowed."""
    return rows.where(F.col(key).isNotNull()).join(declared, rows[key] == declared[declared_key], "left_anti")
