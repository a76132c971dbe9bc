"""Old builds to new: parallel trees overlaid on paths, defaults filled, flows rebuilt from recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import diff as D
from ..operators import match as M
from ..operators.cut import written
from . import builds as B

#: What a leaf without a text gets. Fixed values.
NO_INFO, NO_TAG_INFO, NO_USAGE, OWNER = "<placeholder description>", "<placeholder tag description>", "--", "BAP"


def old_leaves(docs: DataFrame, key: str = "x-attributes") -> DataFrame:
    """Leaves of an old tree: a node whose `required` is text, or that has description and usage as texts."""
    tree = docs.select("build", B.part(F.col("doc"), key).alias("tree")).where("tree is not null")
    nodes = D.shred(tree, ["build"], "tree").where("is_object")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json("canon"), f"$.{k}", "variant")) == "STRING"
    leaf = F.coalesce(kind("required"), F.lit(False)) | F.coalesce(kind("description") & kind("usage"), F.lit(False))
    return nodes.where(leaf).select("build", "path", F.col("canon").alias("leaf"))


def side_tree(docs: DataFrame, key: str, name: str) -> DataFrame:
    """All nodes of a parallel tree that hold an array."""
    tree = docs.select("build", B.part(F.col("doc"), key).alias("tree")).where("tree is not null")
    return D.shred(tree, ["build"], "tree").where(F.col("shape").startswith("ARRAY")).select("build", "path", F.col("canon").alias(name))


def convert_leaf(leaf: Column, enums: Column, tags: Column, kb: Column) -> Column:
    """A new leaf as JSON text."""
    at = lambda k: F.get_json_object(leaf, f"$.{k}")
    has = lambda a: a.isNotNull() & (a != "[]")
    kind = F.when(has(enums) & (at("type").isNull() | (at("type") == "string")), "enum").otherwise(F.coalesce(at("type"), F.lit("string")))
    default = F.struct(F.lit(False).alias("required"), F.lit(NO_USAGE).alias("usage"), F.lit(NO_TAG_INFO).alias("info"), F.lit(OWNER).alias("owner"), F.lit("string").alias("type"))
    parsed = F.from_json(tags, "array<struct<code:string,description:string,list:array<struct<code:string,description:string>>>>")
    describe = lambda d, none: default.withField("info", F.coalesce(d, F.lit(none)))
    item = lambda i: F.struct(i["code"].alias("code"), describe(i["description"], "<placeholder tag list item description>").alias("_description"))
    new_tags = F.transform(parsed, lambda t: F.struct(t["code"].alias("code"), describe(t["description"], NO_TAG_INFO).alias("_description"), F.when(F.size(t["list"]) > 0, F.transform(t["list"], item)).alias("list")))
    return F.to_json(F.struct(
        R.normal_required(at("required")).alias("required"), F.coalesce(at("usage"), F.lit(NO_USAGE)).alias("usage"), F.coalesce(at("description"), kb, F.lit(NO_INFO)).alias("info"), F.coalesce(at("owner"), F.lit(OWNER)).alias("owner"), kind.alias("type"),
        F.when(has(enums), F.from_json(enums, "array<struct<code:string,description:string,reference:string>>")).alias("enums"), F.when(has(tags), new_tags).alias("tags"),
    ))


def convert_attributes(docs: DataFrame, kb: DataFrame | None = None) -> DataFrame:
    """build, path, leaf of the converted attributes; enum and tag trees attach by path, the knowledge base by suffix."""
    rows = old_leaves(docs).join(side_tree(docs, "x-enum", "enums"), ["build", "path"], "left").join(side_tree(docs, "x-tags", "tags"), ["build", "path"], "left")
    rows = rows.withColumn("suffix", F.array_join("path", "."))
    rows = M.kb_lookup(rows, "suffix", kb) if kb is not None else rows.withColumn("kb_info", F.lit(None).cast("string"))
    return rows.select("build", "path", convert_leaf(F.col("leaf"), F.col("enums"), F.col("tags"), F.col("kb_info")).alias("leaf"))


def build_trees(leaves: DataFrame, kb: DataFrame | None = None) -> DataFrame:
    """build, tree: the nested document of converted leaves (build, path, leaf JSON), each under its `_description`.

    Every container gets a description of type object where it has none, from the knowledge base by its path if that
    knows it. Trees fold level by level from the deepest one up, one aggregation a level, keys in order of text.
    """
    rows = leaves.where(F.size("path") > 0)
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    own = rows.select("build", "path", F.col("leaf").alias("own"))
    # What lies above a leaf is a container, also if no leaf describes it.
    above = rows.select("build", F.explode(T.proper_prefixes(F.col("path"))).alias("path")).distinct()
    nodes = above.withColumn("inner", F.lit(True)).join(own, ["build", "path"], "full_outer")
    suffix = F.array_join("path", ".")
    nodes = M.kb_lookup(nodes.withColumn("suffix", suffix), "suffix", kb).drop("suffix") if kb is not None else nodes.withColumn("kb_info", F.lit(None).cast("string"))
    made = F.to_json(F.struct(F.lit(False).alias("required"), F.lit(NO_USAGE).alias("usage"), F.coalesce("kb_info", F.lit(NO_INFO)).alias("info"), F.lit(OWNER).alias("owner"), F.lit("object").alias("type")))
    nodes = written(nodes.select("build", "path", F.coalesce("own", made).alias("own")), "tree-nodes")
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"^\[([\s\S]*)\]$", 1)
    folded = None
    for level in range(deepest, -1, -1):
        here = nodes.where(F.size("path") == level)
        if level == 0:
            here = nodes.select("build").distinct().select("build", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("own"))
        if folded is not None:
            here = here.join(folded, ["build", "path"], "left")
        else:
            here = here.withColumn("inside", F.lit(None).cast("string"))
        text = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"_description":'), F.col("own")), F.col("inside")), F.lit("}"))
        here = here.select("build", "path", text.alias("json"))
        if level == 0:
            return here.select("build", F.col("json").alias("tree"))
        key = F.element_at("path", -1)
        folded = here.select("build", F.slice("path", F.lit(1), F.lit(level - 1)).alias("path"), F.struct(key.alias("key"), F.concat(quoted(key), F.lit(":"), F.col("json")).alias("text")).alias("child"))
        folded = folded.groupBy("build", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: c["text"]), ",").alias("inside"))


def convert_build(docs: DataFrame, kb: DataFrame | None = None, use_case: str = "default") -> DataFrame:
    """build, doc: whole builds with their attributes in the new form; enum and tag trees are gone into the leaves, all other sections stay."""
    trees = build_trees(convert_attributes(docs, kb), kb)
    sets = F.concat(F.lit('[{"meta":{"use_case_id":"' + use_case + '"},"attribute_set":'), F.col("tree"), F.lit("}]"))
    rows = docs.join(trees, "build", "left")
    kept = F.map_filter(F.from_json("doc", "map<string,variant>"), lambda k, _: ~k.isin("x-attributes", "x-enum", "x-tags"))
    member = lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"^\[([\s\S]*)\]$", 1), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null")))
    parts = F.concat(F.transform(F.map_entries(kept), member), F.when(F.col("tree").isNotNull(), F.array(F.concat(F.lit('"x-attributes":'), sets))).otherwise(F.array().cast("array<string>")))
    return rows.select("build", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("doc"))


def convert_flows(steps: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each step takes the next unused payload of its action, latest first. steps: flow_id, step_index, action; payloads: flow_id, action, at, payload."""
    return M.kth_occurrence(steps, payloads, ["flow_id", "action"], ["step_index"], [F.col("at").desc_nulls_last()], ["payload"])


def outcome(results: DataFrame) -> DataFrame:
    """How many conversions went well."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))
