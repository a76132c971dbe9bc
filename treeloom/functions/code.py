"""Property accesses in script source, from its syntax tree: as a table function, and once for all sources of a table that differ only in their words.

A chain's path leaves its root out; a root that stands for another chain (a declared copy, also by
spread, JSON or structuredClone, a destructured name, the element of an iteration or a for-of loop)
gives that chain's path before its own. A computed member that is no literal gives no record. Records come in the order of
a walk from the top: an assignment before what it assigns. A source that can't be parsed has none.
"""

from __future__ import annotations

import bisect
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .script import Bad, Node, parse

#: Roots whose chains are keys of the session, callbacks whose argument is an element, longest condition kept, hops to a condition. Fixed values.
SESSION = ("sessionData", "session", "sessionStorage")
ITERATIONS = ("forEach", "map", "filter", "find", "some", "every", "flatMap", "reduce")
CONDITION_CHARS, CONDITION_HOPS = 160, 12

_MEMBERS = ("MemberExpression", "OptionalMemberExpression")
_CALLS = ("CallExpression", "OptionalCallExpression")
#: Levels of nesting that a source may have.
_LEVELS = 20_000


def condition_text(node: Node) -> str:
    """A condition in short: names, literals, members, operators and calls; whatever else it has is left out."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.type == "Identifier":
            out.append(n.name)
        elif n.type == "StringLiteral":
            out.append(f'"{n.value}"')
        elif n.type in ("NumericLiteral", "BooleanLiteral"):
            out.append(n.text)
        elif n.type == "NullLiteral":
            out.append("null")
        elif n.type in _MEMBERS:
            p = n.property
            todo += [{"Identifier": f".{p.name}", "StringLiteral": f'["{p.value}"]'}.get(p.type, ""), n.object]
        elif n.type == "BinaryExpression":
            todo += [n.kids[1], f" {n.operator} ", n.kids[0]]
        elif n.type == "UnaryExpression":
            todo += [n.argument, f"{n.operator} "]
        elif n.type == "CallExpression":
            todo += ["(…)", n.callee]
    text = " ".join("".join(out).split())
    return text if len(text) <= CONDITION_CHARS else text[: CONDITION_CHARS - 1] + "…"


class _Walk:
    """One walk over a tree: what names stand for at each point, and the records."""

    def __init__(self):
        self.stands_for: dict[str, list[str]] = {}
        self.records: list[tuple] = []

    def chain(self, node: Node) -> tuple[list[str], str | None] | None:
        """Path of a chain of members and its session key; None where a member is dynamic or the root is no name."""
        own: list[str] = []
        while node.type in _MEMBERS:
            p = node.property
            if node.computed:
                if p.type not in ("StringLiteral", "NumericLiteral"):
                    return None
                own.append(p.value if p.type == "StringLiteral" else p.text)
            elif p.type == "Identifier":
                own.append(p.name)
            else:
                return None
            node = node.object
        if node.type != "Identifier":
            return None
        own.reverse()
        if node.name in SESSION:
            return own, own[0] if own else None
        return self.stands_for.get(node.name, []) + own, None

    def copied(self, node: Node | None) -> list[str] | None:
        """The path that a declared value is a copy of."""
        while node is not None:
            if node.type in _MEMBERS or node.type == "Identifier":
                found = self.chain(node)
                return found[0] if found else None
            if node.type == "ObjectExpression":
                return next((path for p in node.properties if p.type == "SpreadElement" and (path := self.copied(p.kids[0])) is not None), None)
            if node.type not in _CALLS:
                return None
            c = node.callee
            json = c.type in _MEMBERS and c.object.type == "Identifier" and c.object.name == "JSON" and c.property.type == "Identifier" and c.property.name in ("parse", "stringify")
            if not json and not (c.type == "Identifier" and c.name == "structuredClone"):
                return None
            node = node.arguments[0] if node.arguments else None
        return None

    def declare(self, node: Node) -> None:
        path = self.copied(node.init)
        if path is None:
            return
        if node.id.type == "Identifier":
            self.stands_for[node.id.name] = path
        elif node.id.type == "ObjectPattern":
            for p in node.id.properties:
                if p.type == "ObjectProperty" and p.key.type == "Identifier" and p.value.type == "Identifier":
                    self.stands_for[p.value.name] = [*path, p.key.name]

    def element(self, node: Node) -> str | None:
        """The name that stands for an element inside this node; it is bound."""
        name = over = None
        if node.type in _CALLS and node.callee.type in _MEMBERS and node.callee.property.type == "Identifier" and node.callee.property.name in ITERATIONS:
            f = node.arguments[0] if node.arguments else None
            if f is not None and f.type in ("FunctionExpression", "ArrowFunctionExpression") and f.params and f.params[0].type == "Identifier":
                name, over = f.params[0].name, node.callee.object
        elif node.type == "ForOfStatement":
            left = node.left.declarations[0].id if node.left.type == "VariableDeclaration" else node.left
            name, over = (left.name, node.right) if left.type == "Identifier" else (None, None)
        path = self.chain(over) if name else None
        if path is None:
            return None
        self.stands_for[name] = [*path[0], "[*]"]
        return name

    def record(self, node: Node, role: str, above: list[Node]) -> None:
        found = self.chain(node)
        if not found or not found[0]:
            return
        gate = None
        if role == "write":
            around = next((a for a in reversed(above[-CONDITION_HOPS:]) if a.type in ("IfStatement", "ConditionalExpression")), None)
            gate = (condition_text(around.test) or None) if around is not None else None
        self.records.append((found[0], role, gate, found[1], node.start))

    def enter(self, node: Node, above: list[Node]) -> None:
        parent = above[-1] if above else None
        if node.type == "VariableDeclarator":
            self.declare(node)
        elif node.type == "AssignmentExpression":
            if node.left.type in _MEMBERS:
                self.record(node.left, "write", above)
        elif node.type == "UnaryExpression":
            if node.operator == "delete" and node.argument.type in _MEMBERS:
                self.record(node.argument, "delete", above)
        elif node.type in _MEMBERS and not (parent.type in _MEMBERS and parent.object is node):
            told = parent.type == "AssignmentExpression" and parent.left is node or parent.type == "UnaryExpression" and parent.operator == "delete"
            if not told or node.type == "OptionalMemberExpression":
                self.record(node, "read", above)

    def run(self, top: Node) -> list[tuple]:
        above: list[Node] = []
        todo: list = [top]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):  # the end of a node: what a name stood for before it
                name, before = node
                above.pop()
                if name is not None and before is None:
                    self.stands_for.pop(name, None)
                elif name is not None:
                    self.stands_for[name] = before
                continue
            outer = dict(self.stands_for) if node.type in (*_CALLS, "ForOfStatement") else {}
            name = self.element(node) if node.type in (*_CALLS, "ForOfStatement") else None
            self.enter(node, above)
            above.append(node)
            todo.append((name, outer.get(name)))
            todo += reversed(node.kids)
        return self.records


def scan(src: str) -> list[tuple]:
    """(path segments, role, gate, session key, line) of each access, in the order of the walk."""
    levels = sys.getrecursionlimit()
    sys.setrecursionlimit(max(levels, _LEVELS))
    try:
        found = _Walk().run(parse(src or ""))
    except (Bad, RecursionError):
        return []
    finally:
        sys.setrecursionlimit(levels)
    ends = [k for k, c in enumerate(src or "") if c == "\n"]
    return [(*record, bisect.bisect_left(ends, start) + 1) for *record, start in found]


_FIELDS = "path array<string>, role string, gate string, session_key string, line int, place int"


@udtf(returnType=_FIELDS, useArrow=True)
class AccessRecords:
    """SQL table function: a row per property access in a source; `place` numbers them in its order."""

    def eval(self, src: str):
        for place, record in enumerate(scan(src)):
            yield (*record, place)


def register(spark) -> None:
    spark.udtf.register("access_records", AccessRecords)


#: Characters of sources and templates that a task remembers, about.
CACHE_CHARS = 8 << 20
#: Names that end in digits and whole numbers: in their place a template has others of the same length.
_WORD = re.compile(r"((?<![\w$])(?:[A-Za-z_$]+[0-9]+(?![\w$])|(?<!\.)[1-9][0-9]{0,14}(?![\w$.])))")
_ZEROS = str.maketrans("123456789", "000000000")
#: What a template can't stand for: numbers that are printed in another way, and members of a number.
_OTHER_NUMBER = re.compile(r"(?<![\w$])(?!0(?![\w$.]))\d")
_NUMBER_MEMBER = re.compile(r"(?<![\w$])\d[\w$]*(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*\.")


class _Template:
    """The records of sources that differ only in their words: flat columns, and where they take words of the source."""

    def __init__(self, records: list[tuple], words: dict[str, int]):
        self.paths = [x for r in records for x in r[0]]
        self.sizes = [len(r[0]) for r in records]
        self.roles, self.gates, self.keys, self.lines = ([r[k] for r in records] for k in range(1, 5))
        self.places = list(range(len(records)))
        self.fills = []
        for own in (self.paths, self.gates, self.keys) if words else ():
            for at, text in enumerate(own):
                parts = _WORD.split(text) if text else []
                if len(parts) == 3 and not parts[0] and not parts[2]:
                    self.fills.append((own, at, words[parts[1]], None))
                elif len(parts) > 1:
                    self.fills.append((own, at, None, [words[x] if k % 2 else x for k, x in enumerate(parts)]))

    def fill(self, words: list[str]) -> None:
        for own, at, word, parts in self.fills:
            own[at] = words[word] if parts is None else "".join([words[x] if type(x) is int else x for x in parts])


class Templates:
    """scan() for many sources. Those that are equal but for their words, with the same ones equal, are parsed once.

    Only the shape of a source decides its tree, so a template is parsed with words of the same lengths in place of its own, and
    the records get each source's words. Sources with escapes, other numbers than whole ones or conditions that are
    cut are parsed themselves, equal ones once.
    """

    def __init__(self):
        self.known: dict[tuple | str, _Template | None] = {}
        self.chars = 0

    def of(self, src: str) -> _Template:
        """The template with this source's words in it, until the next call."""
        parts = _WORD.split(src)
        words = parts[1::2]
        parts[1::2] = [w.translate(_ZEROS) for w in words]
        same = len(words)
        if len(set(words)) < same:
            first: dict[str, int] = {}
            same = tuple([first.setdefault(w, k) for k, w in enumerate(words)])
        key = (same, *parts)
        found = self.known.get(key, self)
        if found is self:
            found = self._keep(key, src, self._parsed(parts, words))
        if found is None:
            found = self.known.get(src) or self._keep(src, src, _Template(scan(src), {}))
        elif found.fills:
            found.fill(words)
        return found

    def _keep(self, key, src: str, found: _Template | None) -> _Template | None:
        self.chars += len(src) + 100
        if self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = len(src)
        self.known[key] = found
        return found

    @staticmethod
    def _parsed(parts: list[str], words: list[str]) -> _Template | None:
        others: dict[str, str] = {}
        given: dict[str, int] = {}
        for word, shape in zip(words, parts[1::2], strict=True):
            if word not in others:
                n = given[shape] = given.get(shape, -1) + 1
                name, size = shape.rstrip("0"), len(shape)
                others[word] = name + str(n).zfill(size - len(name)) if name else str(10 ** (size - 1) + n)
        whole = list(parts)
        whole[1::2] = [others[w] for w in words]
        text = "".join(whole)
        if "\\" in text or any(_OTHER_NUMBER.search(x) for x in parts[::2]) or _NUMBER_MEMBER.search(text):
            return None
        records = scan(text)
        if any(r[2] and r[2].endswith("…") for r in records):
            return None
        own = {others[w]: words.index(w) for w in others}
        told = {x for r in records for text in (*r[0], r[2], r[3]) if text for x in _WORD.split(text)[1::2]}
        return _Template(records, own) if told <= own.keys() else None


_RECORD = pa.struct([("path", pa.list_(pa.string())), ("role", pa.string()), ("gate", pa.string()), ("session_key", pa.string()), ("line", pa.int32()), ("place", pa.int32())])


def _records(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    templates = Templates()
    for batch in batches:
        paths, sizes, roles, gates, keys, lines, places, counts = ([] for _ in range(8))
        for src in batch.to_pylist():
            if not src:
                counts.append(0)
                continue
            t = templates.of(src)
            counts.append(len(t.places))
            for own, more in ((paths, t.paths), (sizes, t.sizes), (roles, t.roles), (gates, t.gates), (keys, t.keys), (lines, t.lines), (places, t.places)):
                own += more
        offsets = lambda own: pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32))
        columns = [pa.ListArray.from_arrays(offsets(sizes), pa.array(paths, pa.string())), *(pa.array(c, pa.string()) for c in (roles, gates, keys)), pa.array(lines, pa.int32()), pa.array(places, pa.int32())]
        yield pa.ListArray.from_arrays(offsets(counts), pa.StructArray.from_arrays(columns, fields=list(_RECORD)))


def access_table(sources: DataFrame, src: str = "src") -> DataFrame:
    """The accesses in each row's source: the columns of sources and those of access_records.

    Nothing is shuffled: a task parses what its sources have in common once (Templates).
    """
    records = F.arrow_udf(_records, f"array<struct<{_FIELDS}>>")
    return sources.select("*", F.inline(records(F.col(src).cast("string"))))
