"""Evidence of attribute paths: what scripts, saved session data and schemas say about each of them.

Observations are (build, action, path) with the path below the action; steps come from
builds.steps. Every search is an equality join, and a bundle is one row per observation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code
from ..functions import text as T
from ..operators import evidence as E
from ..operators.cut import written
from ..operators.matcher import contained
from . import openapi

SOURCES = ("generate", "validate", "requirements")
FLAGS = ("set_in_generate", "asserted_in_validate", "required_in_requirements")
KEY = ["build", "action", "path_key"]


def accesses(steps: DataFrame) -> DataFrame:
    """Property accesses in the scripts of steps, in the order of the walk: build, action, step, kind, place, chain, role, gate, session_key, snippet."""
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(k).alias("kind"), F.col(f"{k}_source").alias("src")) for i, k in enumerate(SOURCES)])
    scripts = steps.select("build", "action", "step", F.explode(parts).alias("p")).select("build", "action", "step", "p.*").where("src <> ''")
    rows = code.access_table(scripts).withColumnRenamed("place", "nth")
    place = F.struct("step", "part", F.col("nth").alias("n"), F.array_join("path", ".").alias("name"))
    return rows.select("build", "action", "step", "kind", place.alias("place"), T.drop_indices(F.filter("path", lambda s: s != "[*]")).alias("chain"), "role", "gate", "session_key", T.snippet(F.col("src"), F.col("line")).alias("snippet"))


def saved(steps: DataFrame) -> DataFrame:
    """Session keys that steps save: build, action, step, key, jsonpath."""
    rows = steps.select("build", "action", "step", "flow_id", "action_id", F.explode("save_data").alias("key", "jsonpath"))
    return rows.withColumn("jsonpath", F.trim("jsonpath")).where("jsonpath <> ''")


def mentions(steps: DataFrame, paths: DataFrame) -> DataFrame:
    """Comments of a path's own action that mention it, by the first of its forms. Every comment is read once for all forms of its action."""
    blob = F.concat_ws("\n", *[F.col(f"{k}_source") for k in SOURCES])
    notes = steps.select("build", "action", "step", F.posexplode(T.comments(blob)).alias("n", "comment")).distinct()
    forms = paths.select(*KEY, F.posexplode(T.mention_forms(F.col("path"))).alias("form", "mention"))
    found = contained(notes, forms, ["build", "action"], "comment", "mention")
    first = forms.join(found, ["build", "action", "mention"]).groupBy(*KEY, "comment").agg(F.min_by("mention", "form").alias("mention"))
    hit = notes.join(first, ["build", "action", "comment"])
    return hit.select(*KEY, "step", F.lit("comment").alias("kind"), F.struct("step", F.lit(0).alias("part"), F.col("n").alias("n"), F.col("mention").alias("name")).alias("place"), F.trim("comment").alias("snippet"), F.col("mention").alias("matched"))


def presence(steps: DataFrame, paths: DataFrame) -> DataFrame:
    """Whether the tokens of a path occur anywhere in the scripts of each kind, over all steps of the build. Every script is read once for all tokens of its build."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_source").alias("src")) for k in SOURCES])
    scripts = steps.select("build", F.explode(kinds).alias("s")).select("build", "s.kind", F.col("s.src").alias("src")).distinct()
    tokens = paths.select(*KEY, F.explode(T.presence_tokens(T.drop_indices(F.col("path")))).alias("token"))
    found = contained(scripts, tokens, ["build"], "src", "token")
    hits = found.join(scripts, ["build", "src"]).select("build", "token", "kind").distinct()
    own = tokens.join(hits, ["build", "token"]).groupBy(*KEY).agg(*[F.bool_or(F.col("kind") == k).alias(flag) for k, flag in zip(SOURCES, FLAGS, strict=True)])
    return paths.select(*KEY).join(own, KEY, "left").select(*KEY, *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])


def bundles(builds: DataFrame, steps: DataFrame, observations: DataFrame) -> DataFrame:
    """A row per observation (build, action, path, path_key): refs, save_data, session_reads, flags and schema.

    References come from steps of the same action, with caps per step, and are chosen by kind; saved data
    are direct hits of the same action, then ancestors' from any step; the first saved key is looked up as a
    word in other actions' scripts.
    """
    steps = written(steps.withColumn("step", F.struct("flow_id", "step_index")), "mining-steps")
    paths = written(observations.select("build", "action", "path", "path_key").distinct(), "mining-paths")
    reads = written(accesses(steps), "mining-accesses")
    kept = saved(steps)
    # Chains that end like a path.
    chains = reads.select("build", "action", "step", "kind", "place", "chain", "role", "gate", "snippet")
    same = lambda a: a.withColumnsRenamed({"build": "b2", "action": "a2"})
    hits = E.suffix_join(paths, "path", same(chains), "chain").where("build = b2 and action = a2").drop("b2", "a2")
    refs = hits.select(*KEY, "step", "kind", "place", "snippet", F.array_join("chain", ".").alias("matched"), "role", "gate").unionByName(mentions(steps, paths), allowMissingColumns=True)
    refs = E.capped_refs(refs, KEY, ["step"], "kind", ["place"])
    direct = E.persisted_join(paths, "path", same(kept), "jsonpath").where("build = b2 and action = a2").drop("b2", "a2", "path")
    direct = written(direct.withColumn("inherited", F.lit(False)), "mining-direct")
    above = E.inherited_join(paths, "path", kept.withColumnsRenamed({"build": "b2", "action": "saved_by"}), "jsonpath", direct, [*KEY, "key", "flow_id", "action_id"]).where("build = b2").drop("b2", "path", "saved_by")
    save = direct.unionByName(above.withColumn("inherited", F.lit(True)))
    first = save.groupBy(*KEY).agg(F.min_by("key", F.struct("inherited", "step", "key")).alias("persisted_key"))
    # The first step of another action that mentions the first key as a word.
    words = steps.select(F.col("build").alias("b2"), F.col("action").alias("a2"), F.col("step").alias("other"), F.concat_ws("\n", *[F.col(f"{k}_source") for k in SOURCES]).alias("src"))
    near = words.withColumn("word", F.explode(T.identifiers(F.col("src")))).drop("src")
    alias = first.join(near, (F.col("build") == F.col("b2")) & (F.col("persisted_key") == F.col("word")) & (F.col("action") != F.col("a2")))
    alias = alias.groupBy(*KEY, "persisted_key").agg(F.min("other").alias("step")).select(*KEY, "step", F.lit("alias").alias("kind"), F.struct("step", F.lit(0).alias("part"), F.lit(0).alias("n"), F.col("persisted_key").alias("name")).alias("place"), F.col("persisted_key").alias("snippet"), F.col("persisted_key").alias("matched"))
    used = alias.select(*KEY).withColumn("consumed_across_steps", F.lit(True))
    top = E.diverse_top(refs.unionByName(alias, allowMissingColumns=True), KEY, "kind", ["place"])
    refs = top.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "step", "matched", "role", "gate", "snippet"))).alias("refs"))
    save = save.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("inherited", "step", "key", "jsonpath"))).alias("save_data"))
    # Reads of the session in the same action.
    session = reads.where("session_key is not null").select(F.col("build").alias("b2"), F.col("action").alias("a2"), "place", "chain", "session_key", "snippet")
    plain = paths.withColumn("plain", T.drop_indices(F.col("path"))).drop("path")
    producers = kept.select(F.concat_ws("\u0000", "build", "key").alias("producer_key"), F.col("build").alias("b3"), F.col("action").alias("origin_action"), F.col("jsonpath").alias("origin_path"), T.jsonpath_segments(F.col("jsonpath")).alias("origin_segments"))
    session = session.withColumn("read_key", F.concat_ws("\u0000", "b2", "session_key"))
    # Only reads of the path's own build and action concern it, and so the cap counts within those of the read.
    found = E.session_reads(session, "read_key", "chain", plain, "plain", [*KEY, "b2", "a2"], producers, "producer_key", "origin_segments", ["place", "origin_path"], within={"b3": "build"})
    found = found.where("build = b2 and action = a2 and (b3 is null or b3 = build)")
    reads_of = E.capped_refs(found.withColumn("kind", F.lit("read")), KEY, [], "kind", ["place", "origin_path"], {"read": E.TOP_READS})
    reads_of = reads_of.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "session_key", "origin_action", "origin_path", "snippet"))).alias("session_reads"))
    schema = openapi.schema_paths(builds).select("build", "action", F.array_join("path", ".").alias("path_key"), "description", "custom", F.col("type").alias("schema_type"), F.col("enums").alias("schema_enums"))
    parts = [refs, save, reads_of, first, used, presence(steps, paths), schema.dropDuplicates(KEY)]
    rows = reduce(lambda a, b: a.join(b, KEY, "left"), parts, paths)
    return rows.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("consumed_across_steps", *FLAGS)})


def tallies(rows: DataFrame) -> DataFrame:
    """How many paths have references, saved data and a schema."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("refs").isNotNull()).alias("with_refs"), F.count_if(F.col("save_data").isNotNull()).alias("with_saved"), F.count_if(F.col("schema_type").isNotNull() | F.col("description").isNotNull()).alias("with_schema"))
