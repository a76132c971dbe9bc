"""Versioned specification documents as tables, and their change logs section by section.

A build is a row (build, side, doc): `build` names what is compared, `doc` is JSON text. Sections
are shredded with their position, since order is part of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diff as D
from ..operators.cut import written

#: Fields of the info block that are compared. Fixed values, as are the section names below.
INFO_FIELDS = ("title", "description", "domain", "version", "x-branch-name", "x-reporting")
STORE_SECTIONS = ("info", "flows", "attributes", "errors", "actions", "paths")
ALL_SECTIONS = (*STORE_SECTIONS, "validations", "docs", "components", "security")


def part(doc: Column, *keys: str) -> Column:
    """JSON text below a path of keys; null where it is missing."""
    return F.get_json_object(doc, "$" + "".join(f"['{k}']" for k in keys))


def members(json: Column) -> Column:
    """Elements of a JSON array as JSON texts (strings without quotes)."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def entries_of(json: Column) -> Column:
    """Entries of a JSON object in source order: array of (key, value as JSON text)."""
    return F.coalesce(F.map_entries(F.from_json(json, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))


def flows(builds: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """Flows of documents, and of rows (build, ord, flow as JSON text) beside them."""
    rows = builds.select("build", F.posexplode(members(part(F.col("doc"), "x-flows"))).alias("ord", "flow"))
    return flow_rows(rows if beside is None else rows.withColumn("ord", F.col("ord").cast("long")).unionByName(beside))


def flow_rows(rows: DataFrame) -> DataFrame:
    """Flows from rows (build, ord, flow as JSON text): those of a build needn't fit in one document. `ord` gives their order."""
    f = F.col("flow")
    return rows.select("build", "ord", part(f, "id").alias("id"), part(f, "usecase").alias("usecase"), part(f, "type").alias("type"), part(f, "description").alias("description"), members(part(f, "tags")).alias("tags"), part(f, "config").alias("config"))


def read_configs(flow_table: DataFrame) -> DataFrame:
    """Flows with `read`: actions and payloads of their configuration as steps (api, mock, examples) and transaction_history, by one look at its text.

    Texts that aren't of that shape throughout, or that no variant can be made of (repeated keys, for one), are read path by path.
    """
    step, recorded = "struct<api: string, mock: struct<defaultPayload: string>, examples: array<struct<payload: string>>>", "struct<action: string, payload: string>"
    payload = lambda e: F.struct(part(e, "payload").alias("payload"))
    config = F.col("config")
    by_path = F.struct(
        F.transform(members(part(config, "steps")), lambda s: F.struct(part(s, "api").alias("api"), F.struct(part(s, "mock", "defaultPayload").alias("defaultPayload")).alias("mock"), F.transform(members(part(s, "examples")), payload).alias("examples"))).alias("steps"),
        F.transform(members(part(config, "transaction_history")), lambda h: F.struct(part(h, "action").alias("action"), part(h, "payload").alias("payload"))).alias("transaction_history"),
    )
    # With an option the reader isn't cut down to the fields that are asked for, which would miss what is odd in others.
    rows = flow_table.withColumn("typed", F.from_json(config, f"struct<steps: array<{step}>, transaction_history: array<{recorded}>, _corrupt_record: string>", {"mode": "PERMISSIVE"}))
    whole = F.col("typed").isNotNull() & F.col("typed._corrupt_record").isNull() & F.try_parse_json(config).isNotNull()
    return rows.withColumn("read", F.when(whole, F.struct("typed.steps", "typed.transaction_history")).otherwise(by_path)).drop("typed")


def steps(flow_table: DataFrame, *more: str) -> DataFrame:
    """Steps of flows; `more` names columns of flows that are kept."""
    rows = flow_table.select("build", F.col("id").alias("flow_id"), "usecase", *more, F.posexplode(members(part(F.col("config"), "steps"))).alias("step_index", "step"))
    s = F.col("step")
    return rows.select(
        "build", "flow_id", "usecase", *more, "step_index", part(s, "api").alias("action"), part(s, "action_id").alias("action_id"), part(s, "owner").alias("owner"), part(s, "responseFor").alias("response_for"),
        part(s, "description").alias("description"), F.coalesce(F.from_json(part(s, "mock", "saveData"), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("save_data"),
        *[T.decode_base64(part(s, "mock", k)).alias(f"{k}_source") for k in ("generate", "validate", "requirements")], part(s, "mock", "defaultPayload").alias("default_payload"), members(part(s, "examples")).alias("examples"),
    )


def attribute_sets(builds: DataFrame) -> DataFrame:
    rows = builds.select("build", F.posexplode(members(part(F.col("doc"), "x-attributes"))).alias("ord", "s"))
    return rows.select("build", "ord", F.coalesce(part(F.col("s"), "meta", "use_case_id"), F.lit("default")).alias("use_case"), part(F.col("s"), "meta").alias("meta"), part(F.col("s"), "attribute_set").alias("tree"))


def _raw(json: Column, key: str) -> Column:
    """A field as canonical JSON text, `undefined` where it is missing."""
    return F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")), F.lit("undefined"))


def leaves(sets: DataFrame) -> DataFrame:
    """Leaf descriptions of attribute trees: build, use_case, path (action first), leaf as JSON text, signature."""
    nodes = D.shred(sets, ["build", "use_case"], "tree")
    leaf = nodes.where((F.try_element_at("path", F.lit(-1)) == "_description") & (F.col("is_object") | F.col("shape").startswith("ARRAY")) & (F.size("path") > 1))
    j = F.col("canon")
    # Extra fields count where they are present and not empty values of the language: null, false, 0, "".
    more = [F.when(part(j, k).isNotNull() & ~part(j, k).isin("false", "0", ""), F.concat(F.lit(f'"{k}":'), _raw(j, k))) for k in ("enumrefs", "enums", "tags")]
    core = [F.concat(F.lit(f'"{k}":'), _raw(j, k)) for k in ("info", "owner", "required", "type", "usage")]
    return leaf.select("build", "use_case", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), j.alias("leaf"), F.concat_ws(",", *core, *more).alias("signature"))


def error_codes(builds: DataFrame) -> DataFrame:
    rows = builds.select("build", F.posexplode(members(part(F.col("doc"), "x-errorcodes", "code"))).alias("ord", "e"))
    e = F.col("e")
    return rows.select("build", "ord", part(e, "code").alias("code"), F.coalesce(part(e, "Event"), F.lit("")).alias("Event"), F.coalesce(part(e, "Description"), F.lit("")).alias("Description"), F.coalesce(part(e, "From"), F.lit("")).alias("From"))


def action_edges(builds: DataFrame) -> DataFrame:
    rows = builds.select("build", F.posexplode(entries_of(part(F.col("doc"), "x-supported-actions", "supportedActions"))).alias("ord", "e"))
    return rows.select("build", "ord", F.col("e.key").alias("action"), members(F.col("e.value")).alias("next"))


def action_props(builds: DataFrame) -> DataFrame:
    rows = builds.select("build", F.posexplode(entries_of(part(F.col("doc"), "x-supported-actions", "apiProperties"))).alias("ord", "e"))
    v = F.col("e.value")
    return rows.select("build", "ord", F.col("e.key").alias("action"), part(v, "async_predecessor").alias("async_predecessor"), members(part(v, "transaction_partner")).alias("partners"))


def docs(builds: DataFrame) -> DataFrame:
    rows = builds.select("build", F.posexplode(entries_of(part(F.col("doc"), "x-docs"))).alias("ord", "e"))
    return rows.select("build", "ord", F.col("e.key").alias("slug"), F.col("e.value").alias("content"))


def _entry(section: str, kind, path, summary, before=None, after=None) -> list[Column]:
    none = F.lit(None).cast("string")
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.lit(section).alias("section"), as_col(kind).alias("kind"), as_col(path).alias("path"), as_col(summary).alias("summary"), (none if before is None else before).alias("before"), (none if after is None else after).alias("after")]


def _last(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the last one, as in a map that is filled in order."""
    others = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*others), "ord").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def _came_and_went(d: DataFrame, section: str, path: Column, added: Column, removed: Column) -> DataFrame:
    rows = d.where("kind <> 'modified'")
    return rows.select("build", *_entry(section, F.col("kind"), path, F.when(F.col("kind") == "added", added).otherwise(removed)))


def _field_entries(d: DataFrame, keys: list[str], fields: list[str], section: str, path, summary) -> DataFrame:
    rows = D.field_diff(d, keys, fields)
    return rows.select("build", *_entry(section, "modified", path(F.col("field")), summary(F.col("field")), F.col("before"), F.col("after")))


def _members(d: DataFrame, before: str, after: str, section: str, path: Column, what) -> DataFrame:
    keys = [c for c in d.columns if c not in (before, after)]
    rows = D.member_diff(d, keys, before, after)
    return rows.select("build", *_entry(section, F.col("kind"), path, what(F.col("kind"), F.col("member"))))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def diff_info(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row per build meets its other side, whatever the number of fields."""
    fields = [*((f"info.{k}", f"{k} changed", ("info", k)) for k in INFO_FIELDS), ("openapi", "OpenAPI version changed", ("openapi",))]

    def values(b: DataFrame, name: str, cases: str) -> DataFrame:
        doc = F.col("doc")
        return b.select("build", F.array(*[F.coalesce(part(doc, *at), F.lit("")) for _, _, at in fields]).alias(name), members(part(doc, "info", "x-usecases")).alias(cases))

    both = values(old, "before", "was").join(values(new, "after", "now"), "build")
    cells = [F.struct(F.lit(path).alias("path"), F.lit(said).alias("summary"), F.get("before", F.lit(i)).alias("before"), F.get("after", F.lit(i)).alias("value")) for i, (path, said, _) in enumerate(fields)]
    rows = both.select("build", F.inline(F.filter(F.array(*cells), lambda c: c["before"] != c["value"])))
    changed = rows.select("build", *_entry("info", "modified", F.col("path"), F.col("summary"), F.col("before"), F.col("value")))
    came = _members(both.select("build", "was", "now"), "was", "now", "info", F.lit("info.x-usecases"), lambda k, m: _say("Use case ", k, ': "', m, '"'))
    return changed.unionByName(came)


def _rooted(rows: DataFrame, section: str, keys: list[str], root: Column, label: Column) -> DataFrame:
    """Entries of a deep diff below a root path."""
    dotted = F.array_join("path", ".")
    at = F.when(F.size("path") > 0, F.concat(root, F.lit("."), dotted)).otherwise(root)
    name = F.when(F.size("path") > 0, F.concat(label, F.lit("."), dotted)).otherwise(label)
    verb = F.when(F.col("kind") == "added", "Added: ").when(F.col("kind") == "removed", "Removed: ").otherwise("Changed: ")
    return rows.select("build", *_entry(section, F.col("kind"), at, F.concat(verb, name), F.col("before"), F.col("after")))


def diff_flows(old: DataFrame, new: DataFrame, beside: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """Flows are compared by id; the last of equal ids counts. `beside`: flows as rows that are beside the documents of each side."""
    a, b = [written(_last(flows(x, more), ["build", "id"]), "flows") for x, more in zip((old, new), beside, strict=True)]  # documents are parsed once
    d = D.keyed_diff(a, b, ["build", "id"], ["description", "usecase"])
    base = F.concat(F.lit("x-flows."), F.col("id"))
    out = _came_and_went(d, "flows", base, _say('Flow added: "', F.col("id"), '" (', F.col("usecase_new"), ")"), _say('Flow removed: "', F.col("id"), '"'))
    out = out.unionByName(_field_entries(d, ["build", "id"], ["description", "usecase"], "flows", lambda f: F.concat(base, F.lit("."), f), lambda f: _say('Flow "', F.col("id"), '" ', f, " changed")))
    both = a.select("build", "id", F.col("tags").alias("was")).join(b.select("build", "id", F.col("tags").alias("now")), ["build", "id"])
    out = out.unionByName(_members(both, "was", "now", "flows", F.concat(base, F.lit(".tags")), lambda k, m: _say('Flow "', F.col("id"), '" tag ', k, ': "', m, '"')))
    shared = a.select("build", "id").join(b.select("build", "id"), ["build", "id"], "left_semi")
    pick = lambda t: t.join(shared, ["build", "id"], "left_semi").select("build", "id", F.coalesce("config", F.lit("null")).alias("config"))
    deep = D.deep_diff(pick(a), pick(b), ["build", "id"], "config")
    return out.unionByName(_rooted(deep, "flows", ["build", "id"], F.concat(base, F.lit(".config")), _say('Flow "', F.col("id"), '" config')))


def diff_attributes(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["build", "use_case"]
    a, b = [written(_last(attribute_sets(x), keys), "attribute-sets") for x in (old, new)]
    canon = lambda t: t.withColumn("meta", T.canonical(F.col("meta")))
    d = D.keyed_diff(canon(a), canon(b), keys, ["meta"])
    base = F.concat(F.lit("x-attributes."), F.col("use_case"))
    out = _came_and_went(d, "attributes", base, _say('Attribute use-case added: "', F.col("use_case"), '"'), _say('Attribute use-case removed: "', F.col("use_case"), '"'))
    out = out.unionByName(d.where("kind = 'modified'").select("build", *_entry("attributes", "modified", F.concat(base, F.lit(".meta")), _say('Attribute "', F.col("use_case"), '" meta changed'), T.preview(F.col("meta_old")), T.preview(F.col("meta_new")))))
    shared = a.select(*keys).join(b.select(*keys), keys, "left_semi")
    flat = lambda t: leaves(t.join(shared, keys, "left_semi")).groupBy(*keys, F.array_join("path", ".").alias("dotted")).agg(F.max("signature").alias("signature"))
    l = D.keyed_diff(flat(a), flat(b), [*keys, "dotted"], ["signature"])  # noqa: E741
    word = F.when(F.col("kind") == "modified", "changed").otherwise(F.col("kind"))
    only = F.col("kind") == "modified"
    text = lambda c: F.when(only, F.concat(F.lit("{"), F.col(c), F.lit("}")))
    return out.unionByName(l.select("build", *_entry("attributes", F.col("kind"), F.concat(base, F.lit("."), F.col("dotted")), _say("Attribute ", word, ": ", F.col("dotted")), text("signature_old"), text("signature_new"))))


def diff_errors(old: DataFrame, new: DataFrame) -> DataFrame:
    fields = ["Event", "Description", "From"]
    d = D.keyed_diff(_last(error_codes(old), ["build", "code"]), _last(error_codes(new), ["build", "code"]), ["build", "code"], fields)
    base = F.concat(F.lit("x-errors-codes."), F.col("code"))
    out = _came_and_went(d, "errors", base, _say("Error code added: ", F.col("code"), " — ", F.col("Event_new")), _say("Error code removed: ", F.col("code")))
    return out.unionByName(_field_entries(d, ["build", "code"], fields, "errors", lambda f: F.concat(base, F.lit("."), f), lambda f: _say("Error code ", F.col("code"), ": ", f, " changed")))


def diff_actions(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["build", "action"]
    a, b = action_edges(old), action_edges(new)
    base = F.concat(F.lit("x-supported-actions."), F.col("action"))
    out = _came_and_went(D.keyed_diff(a, b, keys, ["next"]), "actions", base, _say("Action added: ", F.col("action")), _say("Action removed: ", F.col("action")))
    both = a.select(*keys, F.col("next").alias("was")).join(b.select(*keys, F.col("next").alias("now")), keys)
    out = out.unionByName(_members(both, "was", "now", "actions", base, lambda k, m: _say('Action "', F.col("action"), '": next action ', k, ' "', m, '"')))
    a, b = action_props(old), action_props(new)
    base = F.concat(F.lit("x-supported-actions.apiProperties."), F.col("action"))
    d = D.keyed_diff(a, b, keys, ["async_predecessor"])
    out = out.unionByName(_came_and_went(d, "actions", base, _say("API property added: ", F.col("action")), _say("API property removed: ", F.col("action"))))
    none = lambda c: F.coalesce(F.col(c), F.lit("(null)"))
    out = out.unionByName(d.where("kind = 'modified'").select("build", *_entry("actions", "modified", F.concat(base, F.lit(".async_predecessor")), _say('"', F.col("action"), '" async_predecessor changed'), none("async_predecessor_old"), none("async_predecessor_new"))))
    both = a.select(*keys, F.col("partners").alias("was")).join(b.select(*keys, F.col("partners").alias("now")), keys)
    return out.unionByName(_members(both, "was", "now", "actions", F.concat(base, F.lit(".transaction_partner")), lambda k, m: _say('"', F.col("action"), '" transaction_partner ', k, ': "', m, '"')))


def diff_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    paths = lambda b: b.select("build", F.explode(entries_of(part(F.col("doc"), "paths"))).alias("e")).select("build", F.col("e.key").alias("p"), F.col("e.value").alias("ops"))
    a, b = written(paths(old), "paths"), written(paths(new), "paths")
    base = F.concat(F.lit("paths."), F.col("p"))
    out = _came_and_went(D.keyed_diff(a, b, ["build", "p"], ["ops"]), "paths", base, _say("Path added: ", F.col("p")), _say("Path removed: ", F.col("p")))
    shared = a.select("build", "p").join(b.select("build", "p"), ["build", "p"], "left_semi")
    ops = lambda t: t.join(shared, ["build", "p"], "left_semi").select("build", "p", F.explode(entries_of(F.col("ops"))).alias("e")).select("build", "p", F.col("e.key").alias("m"), F.col("e.value").alias("op"))
    keys = ["build", "p", "m"]
    a, b = written(ops(a), "operations"), written(ops(b), "operations")
    name = F.concat(F.upper("m"), F.lit(" "), F.col("p"))
    at = F.concat(base, F.lit("."), F.col("m"))
    out = out.unionByName(_came_and_went(D.keyed_diff(a, b, keys, ["op"]), "paths", at, _say("Method added: ", name), _say("Method removed: ", name)))
    both = a.select(*keys).join(b.select(*keys), keys, "left_semi")
    deep = D.deep_diff(a.join(both, keys, "left_semi"), b.join(both, keys, "left_semi"), keys, "op")
    return out.unionByName(_rooted(deep, "paths", keys, at, name))


def diff_docs(old: DataFrame, new: DataFrame) -> DataFrame:
    d = D.keyed_diff(docs(old), docs(new), ["build", "slug"], ["content"])
    base = F.concat(F.lit("x-docs."), F.col("slug"))
    out = _came_and_went(d, "docs", base, _say('Doc added: "', F.col("slug"), '"'), _say('Doc removed: "', F.col("slug"), '"'))
    chars = lambda c: F.concat(F.length(c).cast("string"), F.lit(" chars"))
    return out.unionByName(d.where("kind = 'modified'").select("build", *_entry("docs", "modified", base, _say('Doc updated: "', F.col("slug"), '"'), chars("content_old"), chars("content_new"))))


def _diff_opaque(key: str, section: str, label: str):
    def run(old: DataFrame, new: DataFrame) -> DataFrame:
        pick = lambda b: b.select("build", F.coalesce(part(F.col("doc"), key), F.lit("null")).alias("v"))
        return _rooted(D.deep_diff(pick(old), pick(new), ["build"], "v"), section, ["build"], F.lit(key), F.lit(label))

    return run


SECTIONS = {
    "info": diff_info, "flows": diff_flows, "attributes": diff_attributes, "errors": diff_errors, "actions": diff_actions, "paths": diff_paths,
    "validations": _diff_opaque("x-validations", "validations", "Validation"), "docs": diff_docs,
    "components": _diff_opaque("components", "components", "Component"), "security": _diff_opaque("security", "security", "Security"),
}


def changelog(old: DataFrame, new: DataFrame, sections: tuple = ALL_SECTIONS, beside: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """All entries of the named sections, for each build that both sides have; builds without a change have no rows. `beside` as in diff_flows."""
    both = old.select("build").join(new.select("build"), "build", "left_semi")
    old, new = [written(x.join(both, "build", "left_semi"), "builds") for x in (old, new)]  # a document is made once, not once for each section
    beside = tuple(None if x is None else x.join(both, "build", "left_semi") for x in beside)
    rows = reduce(DataFrame.unionByName, [diff_flows(old, new, beside) if s == "flows" else SECTIONS[s](old, new) for s in sections])
    order = F.create_map(*[x for i, s in enumerate(sections) for x in (F.lit(s), F.lit(i))])
    return rows.withColumn("ord", order[F.col("section")])


def section_table(entries: DataFrame, cap: int = D.SECTION_CAP) -> DataFrame:
    return D.cap_sections(entries, ["build", "section"], ["ord", "path", "kind", "summary"], cap)


def facts(builds: DataFrame) -> DataFrame:
    """Counts for an overview: flows, attribute sets, errors, actions, and the list of flows."""
    d = F.col("doc")
    names = F.transform(members(part(d, "x-flows")), lambda f: F.get_json_object(f, "$.id"))
    return builds.select(
        "build", part(d, "info", "domain").alias("domain"), part(d, "info", "version").alias("version"), F.size(members(part(d, "x-flows"))).alias("n_flows"), F.size(members(part(d, "x-attributes"))).alias("n_attribute_sets"),
        F.size(members(part(d, "x-errorcodes", "code"))).alias("n_errors"), F.size(entries_of(part(d, "x-supported-actions", "supportedActions"))).alias("n_actions"), names.alias("flows"),
    )


def envelope(builds: DataFrame) -> DataFrame:
    """What a store keeps of a build beside its flows, attributes, validations and docs: names, use cases, and open sections as JSON text."""
    d = F.col("doc")
    at = lambda name, *keys: part(d, *keys).alias(name)
    return builds.select(
        "build", at("domain", "info", "domain"), at("version", "info", "version"), at("openapi", "openapi"), at("title", "info", "title"), at("description", "info", "description"),
        at("branch_name", "info", "x-branch-name"), (part(d, "info", "x-reporting") == "true").alias("reporting"), members(part(d, "info", "x-usecases")).alias("usecases"), at("security", "security"), at("paths", "paths"),
        at("components", "components"), at("error_codes", "x-errorcodes", "code"), at("supported_actions", "x-supported-actions", "supportedActions"), at("api_properties", "x-supported-actions", "apiProperties"),
    )


def validations(builds: DataFrame) -> DataFrame:
    return builds.select("build", part(F.col("doc"), "x-validations").alias("rules"))


def _in_order(items: Column) -> Column:
    """Collected structs by their ord; other fields need no order."""
    listed = F.array_sort(F.collect_list(items), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    return F.transform(listed, lambda r: r.dropFields("ord"))


def rebuild(meta: DataFrame, flow_rows: DataFrame, set_rows: DataFrame, rule_rows: DataFrame, doc_rows: DataFrame) -> DataFrame:
    """build, doc: whole builds from what a store keeps of them; the differs see no difference to what was stored.

    meta as from envelope, the others as from flows, attribute_sets, validations and docs. Fields that a build
    didn't have are left out again. Open sections keep their members, whose keys are sorted.
    """
    json = lambda c: F.try_parse_json(F.col(c))
    f = flow_rows.groupBy("build").agg(_in_order(F.struct("ord", F.lit("playground").alias("type"), "id", "usecase", "tags", "description", json("config").alias("config"))).alias("x-flows"))
    a = set_rows.groupBy("build").agg(_in_order(F.struct("ord", json("meta").alias("meta"), json("tree").alias("attribute_set"))).alias("x-attributes"))
    d = doc_rows.groupBy("build").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "slug", "content"))), lambda r: F.struct(r["slug"], r["content"]))).alias("x-docs"))
    rows = meta.join(f, "build", "left").join(a, "build", "left").join(d, "build", "left").join(rule_rows.select("build", json("rules").alias("x-validations")), "build", "left")
    info = F.struct("domain", "version", F.col("usecases").alias("x-usecases"), F.col("reporting").alias("x-reporting"), "title", "description", F.col("branch_name").alias("x-branch-name"))
    empty = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    whole = F.struct(
        "openapi", info.alias("info"), json("security").alias("security"), json("paths").alias("paths"), json("components").alias("components"), F.struct(json("error_codes").alias("code")).alias("x-errorcodes"),
        F.struct(json("supported_actions").alias("supportedActions"), json("api_properties").alias("apiProperties")).alias("x-supported-actions"),
        F.try_parse_json(empty("x-flows")).alias("x-flows"), F.try_parse_json(empty("x-attributes")).alias("x-attributes"), "x-validations", "x-docs",
    )
    return rows.select("build", F.to_json(whole).alias("doc"))


def reconstruct(meta: DataFrame, doc_rows: DataFrame, flow_rows: DataFrame) -> DataFrame:
    """Stored rows back to one document per build: info fields, docs in order, flows in order."""
    d = doc_rows.groupBy("build").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "slug", "content"))), lambda r: F.struct(r["slug"], r["content"]))).alias("x-docs"))
    f = flow_rows.groupBy("build").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "usecase", "type", "description", "tags"))), lambda r: r.dropFields("ord")).alias("x-flows"))
    rows = meta.join(d, "build", "left").join(f, "build", "left")
    info = F.struct(*[F.col(c) for c in meta.columns if c != "build"])
    return rows.select("build", F.to_json(F.struct(info.alias("info"), F.col("x-docs"), F.col("x-flows"))).alias("doc"))
