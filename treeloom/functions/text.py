"""Column expressions over strings, JSON text and path arrays; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common words that tokens() leaves out. Fixed values.
STOPWORDS = ("the", "a", "an", "of", "to", "in", "for", "and", "or", "with", "is", "are", "this", "that", "be", "by", "from", "as", "on", "it", "at", "its", "into", "when", "then", "than")
#: Patterns of the regular-expression scanners. Fixed values.
ISO_8601 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"
QUOTED_PATH = r"""["']([$\w][\w$.\[\]]{2,200})["']"""
LINE_COMMENT, BLOCK_COMMENT = r"//[^\n]*", r"/\*[\s\S]*?\*/"
IDENTIFIER = r"[A-Za-z_$][\w$]*"
CHAIN = IDENTIFIER + r"(?:\s*(?:\?\.)?\s*(?:\.\s*[A-Za-z_$][\w$]*|\[\s*\d+\s*\]|\[\s*\"[^\"]+\"\s*\]|\[\s*'[^']+'\s*\]))+"

PREVIEW_CHARS = 120


def canonical(json: Column) -> Column:
    """JSON text with keys sorted at every depth; text that is no JSON stays itself, a missing value is `undefined`."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json, F.lit("undefined"))


def preview(json: Column, chars: int = PREVIEW_CHARS) -> Column:
    """A value for people: (empty) for null, strings without quotes, long ones cut and marked."""
    value = F.try_parse_json(json)
    text = F.when(json.isNull() | (F.trim(json) == "null"), F.lit("(empty)")).when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(json)
    return truncate(text, chars)


def truncate(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def array_minus(a: Column, b: Column) -> Column:
    """Elements of a that are not in b, with repeats and in order (array_except would drop repeats)."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def snake_to_camel(name: Column) -> Column:
    """An underscore before a lower-case letter or digit goes, the letter is raised; other underscores stay."""
    parts = F.split(F.regexp_replace(name, r"_(?=[a-z0-9])", "\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))), "")


def camel_to_snake(name: Column) -> Column:
    """An underscore between a lower-case letter or digit and a capital; runs of capitals stay together."""
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def case_variants(name: Column) -> Column:
    """The name and its snake and camel forms, without repeats."""
    return F.array_distinct(F.array(name, camel_to_snake(name), snake_to_camel(name)))


def path_variants(path: Column) -> Column:
    """The path and its snake and camel forms, without repeats."""
    return F.array_distinct(F.array(path, F.transform(path, lambda s: camel_to_snake(s)), F.transform(path, lambda s: snake_to_camel(s))))


def safe_name(text: Column) -> Column:
    """Everything but letters, digits, underscore and hyphen becomes an underscore."""
    return F.regexp_replace(text, r"[^a-zA-Z0-9_-]", "_")


def word_name(text: Column) -> Column:
    """Runs of other characters than word characters become an underscore."""
    return F.regexp_replace(text, r"[^\w]+", "_")


def hyphen_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9\-_]", "-")


def title_slug(slug: Column) -> Column:
    """release-notes to Release Notes; the rest of each word stays as it is."""
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def escape_cell(text: Column) -> Column:
    """Text for a table cell."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def split_first(text: Column, separator: str) -> Column:
    """Struct of what stands before and after the first separator; without one, the tail is null."""
    at = F.instr(text, separator)
    head = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    tail = F.when(at > 0, text.substr(at + len(separator), F.length(text)))
    return F.struct(head.alias("head"), tail.alias("tail"))


def kb_suffix(key: Column) -> Column:
    """{domain}.{version}.{action}.{path} without domain and leading numeric parts; null where nothing is left."""
    rest = F.regexp_replace(key, r"^[^.]*(\.[0-9]+)*\.", "")
    return F.when((rest == key) | (rest == "") | rest.rlike(r"^[0-9.]+$"), F.lit(None).cast("string")).otherwise(rest)


def tokens(text: Column) -> Column:
    """Lower-case tokens of four characters or more that are no stopwords, with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+"), lambda t: (F.length(t) >= 4) & ~t.isin(*STOPWORDS))


def shared_tokens(own: Column, known: Column) -> Column:
    """How many of a list of tokens, repeats counted, another list has; the other one is made once a row, not once a token."""
    return F.element_at(F.transform(F.array(known), lambda k: F.size(F.filter(own, lambda t: F.array_contains(k, t)))), 1)


def anchored(info: Column, evidence: Column, least: int = 2) -> Column:
    """True if so many tokens of info, repeats counted, occur in the evidence."""
    return F.coalesce(shared_tokens(tokens(info), tokens(evidence)) >= least, F.lit(False))


def jsonpath_segments(path: Column) -> Column:
    """$.a.b[0].c to [a, b, c]: no root, blanks or indices."""
    clean = F.regexp_replace(F.regexp_replace(path, r"^\$\.?", ""), r"[\[\]'\"]+", ".")
    return drop_indices(F.transform(F.split(clean, r"\."), lambda s: F.trim(s)))


def drop_indices(segments: Column) -> Column:
    return F.filter(segments, lambda s: (s != "") & (s != "*") & ~s.rlike(r"^\d+$"))


def is_strict_prefix(a: Column, b: Column) -> Column:
    return (F.size(a) < F.size(b)) & (F.slice(b, F.lit(1), F.size(a)) == a)


def ends_with(long: Column, tail: Column) -> Column:
    return (F.size(tail) > 0) & (F.size(tail) <= F.size(long)) & (F.slice(long, F.greatest(F.size(long) - F.size(tail) + 1, F.lit(1)), F.size(tail)) == tail)


def proper_prefixes(path: Column) -> Column:
    """All beginnings of a path that are shorter than it and not empty."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(path, F.lit(1), n))).otherwise(F.array().cast("array<array<string>>"))


def suffixes(path: Column) -> Column:
    """All non-empty ends of a path."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, -n, n))).otherwise(F.array().cast("array<array<string>>"))


def match_tails(path: Column, tail: int = 3) -> Column:
    """What an access chain may end with to refer to a path, in any of its case forms: all of it, or its last three segments if it has as many."""
    whole_and_tail = lambda v: F.when(F.size(v) >= tail, F.array(v, F.slice(v, -tail, tail))).otherwise(F.array(v))
    return F.array_distinct(F.flatten(F.transform(path_variants(path), whole_and_tail)))


def presence_tokens(path: Column, least: int = 3) -> Column:
    """Strings whose presence in a source suggests use of a path: its last segment, last two and last three, and case forms of the last and the last two."""
    end = lambda n: F.slice(path, -F.least(F.size(path), F.lit(n)), n)
    dotted = lambda segments: F.array_join(segments, ".")
    last = F.element_at(path, -1)
    two = F.split(dotted(end(2)), r"\.")
    forms = F.array(
        last, dotted(end(2)), dotted(end(3)), snake_to_camel(last), camel_to_snake(last),
        dotted(F.transform(two, lambda s: snake_to_camel(s))), dotted(F.transform(two, lambda s: camel_to_snake(s))),
    )
    return F.when(F.size(path) > 0, F.filter(F.array_distinct(forms), lambda t: F.length(t) >= least)).otherwise(F.array().cast("array<string>"))


def mention_forms(path: Column) -> Column:
    """What a comment may say to mention a path, first things first: all of it and its last two segments, in each case form."""
    names = F.flatten(F.transform(path_variants(drop_indices(path)), lambda v: F.array(F.array_join(v, "."), F.when(F.size(v) >= 2, F.array_join(F.slice(v, -2, 2), ".")))))
    return F.array_compact(names)


def comment_mention(comment: Column, path: Column) -> Column:
    """The form of a path that a comment mentions, tried form by form; null without a mention."""
    return F.get(F.filter(mention_forms(path), lambda t: F.contains(comment, t)), F.lit(0))


def parse_time(text: Column) -> Column:
    """A timestamp of an ISO 8601 text; null where it is none."""
    return F.when(text.rlike(ISO_8601), F.try_to_timestamp(text))


def pointer_segments(pointer: Column) -> Column:
    """#/a~1b/c to [a/b, c]."""
    parts = F.filter(F.split(F.regexp_replace(pointer, r"^#?/?", ""), "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def decode_base64(text: Column) -> Column:
    """Base64 to text; what can't be decoded is empty."""
    return F.coalesce(F.try_to_binary(text, F.lit("base64")).cast("string"), F.lit(""))


def strip_fence(text: Column) -> Column:
    """Without a surrounding code fence and surrounding quotes."""
    body = F.regexp_extract(F.trim(text), r"^```[a-zA-Z]*\n?([\s\S]*?)\n?```$", 1)
    inner = F.trim(F.when(body != "", body).otherwise(text))
    return F.regexp_replace(inner, r"^[\"'](.*)[\"']$", "$1")


def fingerprint(text: Column, chars: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def quoted_paths(source: Column) -> Column:
    """Dotted paths in quotes, as segment arrays of two or more."""
    found = F.filter(F.regexp_extract_all(source, F.lit(QUOTED_PATH), F.lit(1)), lambda s: s.contains("."))
    parts = F.transform(found, lambda s: F.filter(F.transform(F.split(s, r"\.|\[[^\]]*\]"), lambda p: F.trim(p)), lambda p: p != ""))
    return F.filter(parts, lambda p: F.size(p) >= 2)


def comments(source: Column) -> Column:
    """Line comments, then block comments."""
    return F.concat(F.regexp_extract_all(source, F.lit(LINE_COMMENT), F.lit(0)), F.regexp_extract_all(source, F.lit(BLOCK_COMMENT), F.lit(0)))


def chains(source: Column) -> Column:
    """Access chains such as a.b?.c["d"][0], each as its segments without indices."""
    found = F.regexp_extract_all(source, F.lit(CHAIN), F.lit(0))
    return F.transform(found, lambda c: drop_indices(F.filter(F.split(c, r"[^\w$]+"), lambda s: s != "")))


def identifiers(source: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(source, F.lit(IDENTIFIER), F.lit(0)))


def snippet(source: Column, line: Column, around: int = 2) -> Column:
    """The line (from 1) and its neighbours."""
    lines = F.split(source, "\n")
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(lines, first, line + around - first + 1), "\n")
