"""JSON that is nested deeper than Spark's reader goes, with explicit stacks instead of recursion.

Canonical texts are those of VARIANT values: sorted keys, no blanks, decimals without trailing zeros.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

#: Levels that Spark's reader takes. A fixed value.
READER_LEVELS = 1000

_TOKEN = re.compile(r'[ \t\r\n]*(?:(?P<str>"(?:[^"\\\x00-\x1f]|\\.)*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>true|false|null)|(?P<op>[{}\[\]:,]))')


class Value:
    """kind (OBJECT, ARRAY, STRING, BOOLEAN, VOID or DOUBLE), canonical text, and members by key or position."""

    __slots__ = ("canon", "kind", "members")

    def __init__(self, kind: str, canon: str = "", members: list | None = None):
        self.kind, self.canon, self.members = kind, canon, members or []


def _double(value: float) -> str:
    """A double as the JVM prints it."""
    if value in (float("inf"), float("-inf")):
        return '"Infinity"' if value > 0 else '"-Infinity"'
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return repr(value)
    digits, exponent = f"{Decimal(repr(value)):E}".split("E")
    digits = digits.rstrip("0").rstrip(".") if "." in digits else digits
    return f"{digits if '.' in digits else digits + '.0'}E{int(exponent)}"


def _number(text: str) -> str:
    if "e" in text.lower():
        return _double(float(text))
    whole, _, rest = text.lstrip("-").partition(".")
    if len(whole.lstrip("0")) + len(rest) > 38:
        return _double(float(text))
    rest = rest.rstrip("0")
    plain = (whole + "." + rest) if rest else whole
    return "-" + plain if text.startswith("-") and plain.strip("0.") else plain


def parse(text: str) -> tuple[Value, int] | None:
    """The first value of a JSON text and its levels; None where it begins with none or has a key twice."""
    open_: list[tuple[Value, list]] = []  # containers not closed yet, with their own keys
    at, most, key, want = 0, 0, None, "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at, kind, token, done = m.end(), m.lastgroup, m[m.lastgroup], None
        if kind == "op" and token in "{[":
            if want not in ("value", "value or end"):
                return None
            open_.append((Value("OBJECT" if token == "{" else "ARRAY"), [key]))
            most, key, want = max(most, len(open_)), None, "key or end" if token == "{" else "value or end"
            continue
        if kind == "op" and token in "}]":
            if not open_ or (token == "}") != (open_[-1][0].kind == "OBJECT") or want not in ("comma or end", "key or end" if token == "}" else "value or end"):
                return None
            done, (own_key,) = open_.pop()
            if done.kind == "OBJECT":
                done.members.sort(key=lambda m: m[0].encode("utf-16-be"))
                if any(a[0] == b[0] for a, b in zip(done.members, done.members[1:], strict=False)):
                    return None
                done.canon = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v.canon}" for k, v in done.members) + "}"
            else:
                done.canon = "[" + ",".join(v.canon for _, v in done.members) + "]"
            key = own_key
        elif kind == "op":
            if token == ":" and want == "colon":
                want = "value"
            elif token == "," and want == "comma or end":
                want = "key" if open_[-1][0].kind == "OBJECT" else "value"
            else:
                return None
            continue
        elif want in ("key", "key or end"):
            if kind != "str":
                return None
            try:
                key, want = json.loads(token), "colon"
            except ValueError:
                return None
            continue
        elif want not in ("value", "value or end"):
            return None
        elif kind == "str":
            try:
                done = Value("STRING", json.dumps(json.loads(token), ensure_ascii=False))
            except ValueError:
                return None
        elif kind == "num":
            done = Value("DOUBLE", _number(token))
        else:
            done = Value("VOID" if token == "null" else "BOOLEAN", token)
        if open_:
            owner = open_[-1][0]
            owner.members.append((key if owner.kind == "OBJECT" else len(owner.members), done))
            want = "comma or end"
        else:
            return done, most


def deep(text: str) -> Value | None:
    """The value of a text that only this reader takes; None for texts that are no JSON or not that deep."""
    found = parse(text)
    return found[0] if found and found[1] > READER_LEVELS else None


def nodes(top: Value, arrays: bool):
    """(path, canon, kind, depth, place) of all nodes; elements of arrays add to the place, not to the path."""
    todo = [((), top, 0, ())]
    while todo:
        path, v, depth, place = todo.pop()
        yield list(path), v.canon, v.kind, depth, list(place)
        if v.kind == "OBJECT":
            todo += [((*path, k), m, depth + 1, place) for k, m in reversed(v.members)]
        elif v.kind == "ARRAY" and arrays:
            todo += [(path, m, depth + 1, (*place, k)) for k, m in reversed(v.members)]


def differences(a: Value, b: Value):
    """(path, before, after) of what differs; objects on both sides are entered, all else is compared whole."""
    todo = [((), a, b)]
    while todo:
        path, x, y = todo.pop()
        if x is not None and y is not None and x.canon == y.canon:
            continue
        if x is not None and y is not None and x.kind == y.kind == "OBJECT":
            p, q = dict(x.members), dict(y.members)
            todo += [((*path, k), p.get(k), q.get(k)) for k in {**p, **q}]
        else:
            yield list(path), None if x is None else x.canon, None if y is None else y.canon
