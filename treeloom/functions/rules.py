"""Decision rules over leaves, observations and drafts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ISO_8601

#: Texts that stand for a missing one. Fixed values.
PLACEHOLDERS = ("edit later", "edit-later", "tbd", "tba", "--", "<auto>", "please add relevant description")
OVERVIEW_STUB = r"(?i)^add an overview of .* (specification\s+)?here\.?$"
APPROVE_FROM, YELLOW_FROM = 0.8, 0.5
INFO_CHARS, STUB_CHARS, OVERVIEW_CHARS = 15, 20, 40


def is_placeholder(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*PLACEHOLDERS), F.lit(False))


def incomplete_leaf(info: Column, usage: Column, owner: Column, kind: Column) -> Column:
    """A core text is empty or a placeholder, or the description is very short."""
    clean = [F.trim(F.coalesce(c, F.lit(""))) for c in (info, usage, owner, kind)]
    empty = (clean[0] == "") | (clean[1] == "") | (clean[2] == "") | (clean[3] == "")
    return empty | is_placeholder(clean[0]) | is_placeholder(clean[1]) | is_placeholder(clean[2]) | (F.length(clean[0]) < INFO_CHARS)


def description_stub(text: Column) -> Column:
    clean = F.trim(F.coalesce(text, F.lit("")))
    return text.isNull() | (F.length(clean) < STUB_CHARS) | is_placeholder(clean)


def overview_stub(text: Column) -> Column:
    """A first heading aside, the text is short or the template's sentence."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^#[^\n]*(\n|$)", ""))
    return (F.length(body) < OVERVIEW_CHARS) | body.rlike(OVERVIEW_STUB)


def gap_reason(has_leaf: Column, incomplete: Column, force_all: bool = False) -> Column:
    """Why a path is drafted, or that it isn't."""
    if force_all:
        return F.lit("force_all")
    return F.when(~has_leaf, "no_existing_leaf").when(incomplete, "incomplete_existing_leaf").otherwise("complete_existing_leaf")


def normal_required(text: Column) -> Column:
    """Old files say required in words; an empty text is no."""
    clean = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (clean != "") & ~clean.isin("optional", "no", "false", "not required")


def owner_of(action: Column) -> Column:
    return F.when(action.startswith("on_"), "BPP").otherwise("BAP")


def required_flag(seen_flows: Column, flows_of_action: Column) -> Column:
    return (flows_of_action > 0) & (seen_flows >= flows_of_action)


def usage_of(is_leaf: Column, most_common: Column, samples: Column) -> Column:
    """The most common value, else the first sample that isn't null; containers have none."""
    return F.when(~is_leaf, "").otherwise(F.coalesce(most_common, F.get(F.filter(samples, lambda v: v.isNotNull()), F.lit(0)), F.lit("")))


def type_of(has_enums: Column, is_leaf: Column, candidate: Column, value_type: Column) -> Column:
    return (
        F.when(has_enums, "enum").when(~is_leaf, "object").when(F.coalesce(candidate.rlike(ISO_8601), F.lit(False)), "date-time")
        .when(value_type.isin("string", "number", "boolean"), value_type).otherwise("string")
    )


def band(score: Column, threshold: float = APPROVE_FROM) -> Column:
    return F.when(score >= threshold, "green").when(score >= YELLOW_FROM, "yellow").otherwise("red")


def threshold_of(setting: str | None, default: float = APPROVE_FROM) -> float:
    """A threshold given as text; what is no number from 0 to 1 gives the default."""
    try:
        value = float(setting or "")
    except ValueError:
        return default
    return value if 0 <= value <= 1 else default


def concurrency_of(setting: str | None, default: int = 8, most: int = 64) -> int:
    """A whole number from 1 to `most` given as text; what is none gives the default, more is cut."""
    try:
        value = int(float(setting or ""))
    except (ValueError, OverflowError):
        return default
    return min(value, most) if value >= 1 else default


def approved(score: Column, error: Column | None = None, threshold: float = APPROVE_FROM) -> Column:
    ok = score >= threshold
    return ok if error is None else ok & error.isNull()


def _total(factors: dict[str, Column], reason: Column | None = None) -> tuple[Column, Column]:
    """Score in [0, 1] with three decimals, and a map of the factors that count; with a reason not to score, 0 and the reason alone."""
    score = F.round(F.least(F.greatest(sum(factors.values(), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 3)
    entries = F.map_filter(F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), v)]), lambda _, v: v > 0)
    if reason is None:
        return score, entries
    return F.when(reason.isNotNull(), 0.0).otherwise(score), F.when(reason.isNotNull(), F.create_map(reason, F.lit(0.0))).otherwise(entries)


def attribute_score(
    *, openapi: Column, custom: Column, enums: Column, tags: Column, refs: Column, saved: Column, samples: Column, round_trip: Column, persisted: Column, info: Column, is_anchored: Column, fallback: Column
) -> tuple[Column, Column]:
    """Confidence of a drafted attribute; weights and names are fixed values. A fallback text scores 0."""
    give = lambda test, value: F.when(test, value).otherwise(0.0)
    return _total(
        {
            "openapi_description": give(openapi, 0.25), "openapi_custom_description": give(custom, 0.15), "enums_carried_forward": give(enums, 0.15), "tags_carried_forward": give(tags, 0.15),
            "refs_strong": give(refs >= 3, 0.2), "refs_weak": F.when(refs < 3, F.least(refs * 0.05, F.lit(0.15))).otherwise(0.0),
            "save_data": give(saved, 0.1), "sample_variety": give(samples >= 3, 0.1), "cross_flow_round_trip": give(round_trip, 0.1), "cross_flow_persisted": give(persisted, 0.05),
            "info_depth": give(F.length(info) >= 80, 0.1), "info_evidence_anchored": give(is_anchored, 0.05),
        },
        F.when(fallback, F.lit("fallback")),
    )


def description_score(text: Column, *, error: Column, kind: Column, saved_keys: Column, prior_keys: Column, owner: Column, tags: Column, actions: Column) -> tuple[Column, Column]:
    """Confidence of a drafted flow or step description; weights and names are fixed values. A failed draft scores 0."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    step = kind == "step"
    words = F.size(F.filter(F.split(clean, r"\s+"), lambda w: w != ""))
    give = lambda test, value: F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)
    return _total(
        {
            "length_depth": give(F.length(clean) >= 60, 0.3), "length_basic": give((F.length(clean) >= 30) & (F.length(clean) < 60), 0.2),
            "word_count": give(words >= 10, 0.1), "starts_cap": give(clean.rlike(r"^[A-Z]"), 0.05), "ends_punct": give(clean.rlike(r"[.!?]$"), 0.05),
            "step_savedata": give(step & (saved_keys >= 1), 0.15), "step_prev_session": give(step & (prior_keys >= 1), 0.1), "step_owner_known": give(step & (owner != "") & (owner != "unknown"), 0.1),
            "flow_tags": give(~step & (tags >= 1), 0.15), "flow_has_shape": give(~step & (actions >= 3), 0.15),
        },
        F.when(error.isNotNull(), F.lit("error")),
    )
