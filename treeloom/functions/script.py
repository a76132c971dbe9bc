"""A parser of scripts: the syntax tree of a source, as far as the analysis of property accesses needs it.

Recursive descent for statements, precedence climbing for operators. Nodes are named and nested as
the common tree format of the language has them, because conditions are looked for a number of levels up.
"""

from __future__ import annotations

import re


class Bad(ValueError):
    """The source is no script."""


class Node:
    """`type`, where it starts, and fields; `kids` are the children in the order in which they are visited."""

    __slots__ = ("fields", "kids", "start", "type")

    def __init__(self, type_: str, start: int, kids: list, **fields):
        self.type, self.start, self.kids, self.fields = type_, start, [k for k in kids if k is not None], fields

    def __getattr__(self, name):
        return self.fields.get(name)


_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*")
_TOKEN = re.compile(
    r"""(?P<str>"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<private>\#[\w$]+)"""
    r"""|(?P<num>0[xXoObB][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"""
    r"""|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])"""
)
_NAME = re.compile(r"[^\W\d][\w$]*$")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_PREFIX = {"!", "~", "+", "-", "typeof", "void", "delete"}
_RESERVED = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split())
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
_ESCAPE = re.compile(r"\\(?:u\{([\da-fA-F]+)\}|u([\da-fA-F]{4})|x([\da-fA-F]{2})|([\s\S]))")


def _text(quoted: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES.get(m[4], m[4]) if m[4] else chr(int(m[1] or m[2] or m[3], 16)), quoted[1:-1])


def _number(text: str) -> str:
    """A number as the language prints it."""
    text = text.replace("_", "").rstrip("n")
    value = int(text, 0) if text[:2].lower() in ("0x", "0o", "0b") else float(text)
    return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)


class Parser:
    def __init__(self, src: str):
        self.src, self.at, self.generator, self.no_in = src, 0, False, False
        self.kind = self.token = ""
        self.move(0)

    # tokens

    def move(self, at: int) -> None:
        """Read the token from `at` on."""
        self.start = _SKIP.match(self.src, at).end()
        self.newline = "\n" in self.src[at : self.start]
        if self.start == len(self.src):
            self.kind, self.token, self.at = "end", "", self.start
            return
        m = _TOKEN.match(self.src, self.start)
        if not m:
            raise Bad(f"unknown character at {self.start}")
        self.kind, self.token, self.at = m.lastgroup, m.group(), m.end()

    def next(self) -> str:
        token = self.token
        if self.kind == "end":
            raise Bad("the source ends early")
        self.move(self.at)
        return token

    def sees(self, *tokens: str) -> bool:
        return self.kind in ("op", "id") and self.token in tokens

    def take(self, token: str) -> bool:
        if self.sees(token):
            self.next()
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise Bad(f"{token} is missing at {self.start}")

    def semicolon(self) -> None:
        """The end of a statement; where a semicolon is missing, the next statement begins all the same."""
        self.take(";")

    def after(self) -> tuple[str, bool]:
        """The token after this one, and whether a line begins between them."""
        saved = self.start, self.newline, self.kind, self.token, self.at
        self.move(self.at)
        found = self.token if self.kind != "str" else "", self.newline
        self.start, self.newline, self.kind, self.token, self.at = saved
        return found

    def allowing_in(self, parse, allowed: bool = True):
        saved, self.no_in = self.no_in, not allowed
        try:
            return parse()
        finally:
            self.no_in = saved

    # statements

    def program(self) -> Node:
        body = []
        while self.kind != "end":
            body.append(self.statement())
        return Node("Program", 0, body)

    def block(self) -> Node:
        start, body = self.start, []
        self.need("{")
        while not self.take("}"):
            body.append(self.statement())
        return Node("BlockStatement", start, body)

    def condition(self) -> Node:
        self.need("(")
        test = self.allowing_in(self.expression)
        self.need(")")
        return test

    def statement(self) -> Node:
        start, word = self.start, self.token if self.kind in ("id", "op") else ""
        own = getattr(self, f"_{word}", None) if self.kind == "id" else None
        if word == "{":
            return self.block()
        if word == ";":
            self.next()
            return Node("EmptyStatement", start, [])
        if own and not (word == "import" and self.after()[0] in ("(", ".")):
            return own(start)
        if word in ("const", "var") or word == "let" and (self.after()[0] in ("{", "[") or re.match(r"[\w$]", self.after()[0] or " ")):
            out = self.variables()
            self.semicolon()
            return out
        if word == "async" and self.after() == ("function", False):
            self.next()
            return self._function(start)
        if self.kind == "id" and word not in _RESERVED and self.after()[0] == ":":
            self.next()
            self.next()
            return Node("LabeledStatement", start, [self.statement()])
        value = self.expression()
        self.semicolon()
        return Node("ExpressionStatement", start, [value])

    def variables(self) -> Node:
        start, own = self.start, []
        self.next()
        while True:
            at = self.start
            name = self.pattern()
            value = self.assignment() if self.take("=") else None
            own.append(Node("VariableDeclarator", at, [name, value], id=name, init=value))
            if not self.take(","):
                return Node("VariableDeclaration", start, own, declarations=own)

    def _if(self, start):
        self.next()
        test, then = self.condition(), self.statement()
        return Node("IfStatement", start, [test, then, self.statement() if self.take("else") else None], test=test)

    def _for(self, start):
        self.next()
        self.take("await")
        self.need("(")
        first = None
        if not self.sees(";"):
            declared = self.sees("const", "var") or self.sees("let") and self.after()[0] not in ("of", "in", ";", "=")
            first = self.allowing_in(self.variables if declared else self.expression, False)
        for word, type_ in (("of", "ForOfStatement"), ("in", "ForInStatement")):
            if first is not None and self.take(word):
                right = self.allowing_in(self.assignment if word == "of" else self.expression)
                self.need(")")
                first = first if first.type == "VariableDeclaration" else _as_pattern(first)
                return Node(type_, start, [first, right, self.statement()], left=first, right=right)
        self.need(";")
        test = None if self.sees(";") else self.allowing_in(self.expression)
        self.need(";")
        step = None if self.sees(")") else self.allowing_in(self.expression)
        self.need(")")
        return Node("ForStatement", start, [first, test, step, self.statement()])

    def _while(self, start):
        self.next()
        return Node("WhileStatement", start, [self.condition(), self.statement()])

    def _do(self, start):
        self.next()
        body = self.statement()
        self.need("while")
        test = self.condition()
        self.take(";")
        return Node("DoWhileStatement", start, [body, test])

    def _switch(self, start):
        self.next()
        cases = [self.condition()]
        self.need("{")
        while not self.take("}"):
            at, test = self.start, None
            if self.take("case"):
                test = self.expression()
            else:
                self.need("default")
            self.need(":")
            body = []
            while not self.sees("case", "default", "}"):
                body.append(self.statement())
            cases.append(Node("SwitchCase", at, [test, *body]))
        return Node("SwitchStatement", start, cases)

    def _try(self, start):
        self.next()
        own = [self.block()]
        if self.sees("catch"):
            at = self.start
            self.next()
            name = None
            if self.take("("):
                name = self.pattern()
                self.need(")")
            own.append(Node("CatchClause", at, [name, self.block()]))
        if self.take("finally"):
            own.append(self.block())
        return Node("TryStatement", start, own)

    def _return(self, start):
        self.next()
        value = None if self.newline or self.kind == "end" or self.sees(";", "}") else self.expression()
        self.semicolon()
        return Node("ReturnStatement", start, [value])

    _throw = _return

    def _break(self, start):
        self.next()
        if self.kind == "id" and not self.newline:
            self.next()
        self.semicolon()
        return Node("BreakStatement", start, [])

    _continue = _debugger = _break

    def _function(self, start, type_="FunctionDeclaration"):
        self.next()
        many = self.take("*")
        if self.kind == "id" and not self.sees("("):
            self.next()
        return self.body(type_, start, self.parameters(), many)

    def _class(self, start, type_="ClassDeclaration"):
        self.next()
        if self.kind == "id" and not self.sees("extends"):
            self.next()
        base = self.unary() if self.take("extends") else None
        at, own = self.start, []
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.sees("static") and self.after()[0] not in ("(", "=", ";", "}"):
                self.next()
                if self.sees("{"):
                    own.append(self.block())
                    continue
            own.append(self.member_of("Class"))
        return Node(type_, start, [base, Node("ClassBody", at, own)])

    def _import(self, start):
        self.next()
        while not self.sees(";") and self.kind != "end" and not (self.kind == "str"):
            self.next()
        if self.kind == "str":
            self.next()
        self.semicolon()
        return Node("ImportDeclaration", start, [])

    def _export(self, start):
        self.next()
        if self.take("default"):
            inner = self.statement() if self.sees("function", "class", "async") else self.assignment()
            self.take(";")
            return Node("ExportDefaultDeclaration", start, [inner])
        if self.sees("{", "*"):
            while not self.sees(";") and self.kind not in ("end", "str") and not (self.newline and not self.sees("}", "from")):
                self.next()
            if self.kind == "str":
                self.next()
            self.semicolon()
            return Node("ExportNamedDeclaration", start, [])
        return Node("ExportNamedDeclaration", start, [self.statement()])

    # functions and patterns

    def parameters(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.parameter())
            if not self.sees(")"):
                self.need(",")
        return out

    def parameter(self) -> Node:
        start = self.start
        if self.take("..."):
            return Node("RestElement", start, [self.pattern()])
        name = self.pattern()
        return Node("AssignmentPattern", start, [name, self.assignment()]) if self.take("=") else name

    def pattern(self) -> Node:
        if self.sees("{", "["):
            return _as_pattern(self.primary())
        if self.kind != "id" or self.token in _RESERVED:
            raise Bad(f"a name is missing at {self.start}")
        return Node("Identifier", self.start, [], name=self.next())

    def body(self, type_: str, start: int, params: list[Node], many: bool = False) -> Node:
        saved, self.generator = self.generator, many
        arrow = type_ == "ArrowFunctionExpression"
        inner = self.assignment() if arrow and not self.sees("{") else self.allowing_in(self.block)
        self.generator = saved
        return Node(type_, start, [*params, inner], params=params)

    def member_of(self, owner: str) -> Node:
        """A property or method of an object or class."""
        start, many = self.start, False
        if owner == "Object" and self.take("..."):
            return Node("SpreadElement", start, [self.assignment()])
        while self.sees("get", "set", "async") and self.after()[0] not in ("(", ",", ":", "}", "=", ";"):
            self.next()
        many = self.take("*")
        named, key = self.kind == "id", None
        if self.take("["):
            key, named = self.allowing_in(self.assignment), False
            self.need("]")
            computed = True
        else:
            computed = False
            key = Node("Identifier", start, [], name=self.next()) if named else Node("Literal", start, [], text=self.next())
        if self.sees("("):
            return self.body(f"{owner}Method", start, [*([key] if computed else []), *self.parameters()], many)
        if owner == "Class":
            value = self.assignment() if self.take("=") else None
            self.semicolon()
            return Node("ClassProperty", start, [key if computed else None, value])
        if self.take(":"):
            value = self.assignment()
        else:  # shorthand, with a default where this turns out to be a pattern
            value = Node("Identifier", start, [], name=key.name)
            if not named:
                raise Bad(f": is missing at {self.start}")
            if self.take("="):
                value = Node("AssignmentPattern", start, [value, self.assignment()])
        return Node("ObjectProperty", start, [key, value], key=key, value=value)

    # expressions

    def expression(self) -> Node:
        start, own = self.start, [self.assignment()]
        while self.take(","):
            own.append(self.assignment())
        return own[0] if len(own) == 1 else Node("SequenceExpression", start, own)

    def assignment(self) -> Node:
        start = self.start
        if self.sees("yield") and self.generator:
            self.next()
            self.take("*")
            value = None if self.newline or self.sees(")", "]", "}", ",", ";") or self.kind == "end" else self.assignment()
            return Node("YieldExpression", start, [value])
        if self.kind == "id" and self.token not in _RESERVED:
            then, broken = self.after()
            if then == "=>" and not broken:
                name = self.pattern()
                self.next()
                return self.body("ArrowFunctionExpression", start, [name])
            if self.token == "async" and not broken and _NAME.match(then) and then not in ("function", "of", "in", "instanceof"):
                self.next()
                return self.assignment()
        left = self.binary(0)
        if self.sees("=>") and not self.newline and left.type in ("Cover", "CallExpression"):
            self.next()
            return self.body("ArrowFunctionExpression", start, [_as_pattern(p) for p in (left.items if left.type == "Cover" else left.arguments)])
        left = _uncovered(left)
        if self.kind == "op" and self.token in _ASSIGN:
            left = _as_pattern(left) if self.token == "=" else left
            self.next()
            right = self.assignment()
            return Node("AssignmentExpression", start, [left, right], left=left)
        if self.take("?"):
            then = self.allowing_in(self.assignment)
            self.need(":")
            return Node("ConditionalExpression", start, [left, then, self.assignment()], test=left)
        return left

    def binary(self, least: int) -> Node:
        start, left = self.start, self.unary()
        while True:
            power = _BINARY.get(self.token, 0) if self.kind in ("op", "id") else 0
            if power <= least or self.token == "in" and self.no_in:
                return left
            op = self.next()
            left = _uncovered(left)
            right = _uncovered(self.binary(power - (op == "**")))
            left = Node("BinaryExpression", start, [left, right], operator=op)

    def unary(self) -> Node:
        start = self.start
        if self.kind in ("op", "id") and self.token in _PREFIX:
            op = self.next()
            argument = _uncovered(self.unary())
            return Node("UnaryExpression", start, [argument], operator=op, argument=argument)
        if self.sees("++", "--"):
            self.next()
            return Node("UpdateExpression", start, [self.unary()])
        if self.sees("await") and not self.after()[1] and self.after()[0] not in ("", ")", ";", ",", "=", ".", "=>", "]", "}", ":"):
            self.next()
            return Node("AwaitExpression", start, [_uncovered(self.unary())])
        value = self.chain(self.primary(), start)
        if self.sees("++", "--") and not self.newline:
            self.next()
            return Node("UpdateExpression", start, [value])
        return value

    def chain(self, value: Node, start: int, calls: bool = True) -> Node:
        optional = False  # from ?. on all members of the chain count as optional ones
        while True:
            begun = self.sees("?.") and calls
            if begun:
                optional = True
                self.next()
            if self.sees("(") and calls:
                own = self.arguments()
                value = _uncovered(value)
                value = Node("OptionalCallExpression" if optional else "CallExpression", start, [value, *own], callee=value, arguments=own)
            elif self.take("["):
                value = _uncovered(value)
                prop = self.allowing_in(self.expression)
                self.need("]")
                value = Node("OptionalMemberExpression" if optional else "MemberExpression", start, [value, prop], object=value, property=prop, computed=True)
            elif begun or self.take("."):
                value = _uncovered(value)
                at, kind = self.start, self.kind
                if kind not in ("id", "private"):
                    raise Bad(f"a property is missing at {at}")
                prop = Node("Identifier" if kind == "id" else "PrivateName", at, [], name=self.next())
                value = Node("OptionalMemberExpression" if optional else "MemberExpression", start, [value, prop], object=value, property=prop)
            elif self.sees("`"):
                value = Node("TaggedTemplateExpression", start, [_uncovered(value), self.template()])
            else:
                return value

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            start = self.start
            out.append(Node("SpreadElement", start, [self.allowing_in(self.assignment)]) if self.take("...") else self.allowing_in(self.assignment))
            if not self.sees(")"):
                self.need(",")
        return out

    def template(self) -> Node:
        start, at, own = self.start, self.start + 1, []
        while True:
            m = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*").match(self.src, at)
            at = m.end()
            if self.src[at : at + 1] == "`":
                self.move(at + 1)
                return Node("TemplateLiteral", start, own)
            if self.src[at : at + 2] != "${":
                raise Bad("a template doesn't end")
            self.move(at + 2)
            own.append(self.allowing_in(self.expression))
            if not self.sees("}"):
                raise Bad("a template's expression doesn't end")
            at = self.start + 1

    def primary(self) -> Node:
        start, kind, token = self.start, self.kind, self.token
        if kind == "str":
            return Node("StringLiteral", start, [], value=_text(self.next()))
        if kind == "num":
            return Node("NumericLiteral", start, [], text=_number(self.next()))
        if kind == "private":
            return Node("PrivateName", start, [], name=self.next())
        if token in ("/", "/=") and kind == "op":
            m = _REGEX.match(self.src, start)
            if not m:
                raise Bad("a pattern doesn't end")
            self.move(m.end())
            return Node("RegExpLiteral", start, [])
        if token == "`":
            return self.template()
        if token == "(":
            return self.allowing_in(self.covered)
        if token == "[":
            return self.allowing_in(self.array)
        if token == "{":
            self.next()
            own = []
            while not self.take("}"):
                own.append(self.allowing_in(lambda: self.member_of("Object")))
                if not self.sees("}"):
                    self.need(",")
            return Node("ObjectExpression", start, own, properties=own)
        if kind != "id":
            raise Bad(f"an expression is missing at {start}")
        if token == "function" or token == "async" and self.after() == ("function", False):
            self.take("async")
            return self._function(start, "FunctionExpression")
        if token == "class":
            return self._class(start, "ClassExpression")
        if token == "new":
            self.next()
            if self.take("."):
                self.next()
                return Node("MetaProperty", start, [])
            at = self.start
            callee = _uncovered(self.chain(self.primary(), at, calls=False))
            return Node("NewExpression", start, [callee, *(self.arguments() if self.sees("(") else [])])
        if token in ("true", "false"):
            return Node("BooleanLiteral", start, [], text=self.next())
        if token in ("null", "this", "super", "import"):
            self.next()
            return Node({"null": "NullLiteral", "this": "ThisExpression", "super": "Super", "import": "Import"}[token], start, [])
        if token in _RESERVED:
            raise Bad(f"{token} at {start}")
        return Node("Identifier", start, [], name=self.next())

    def covered(self) -> Node:
        """What stands in parentheses: an expression, or the parameters of an arrow function."""
        start, items = self.start, []
        self.need("(")
        while not self.take(")"):
            at = self.start
            items.append(Node("SpreadElement", at, [self.assignment()]) if self.take("...") else self.assignment())
            if not self.sees(")"):
                self.need(",")
        return Node("Cover", start, items, items=items)

    def array(self) -> Node:
        start, items = self.start, []
        self.need("[")
        while not self.take("]"):
            at = self.start
            if self.take(","):
                continue
            items.append(Node("SpreadElement", at, [self.assignment()]) if self.take("...") else self.assignment())
            if not self.sees("]"):
                self.need(",")
        return Node("ArrayExpression", start, items)


def _uncovered(node: Node) -> Node:
    """The expression in parentheses."""
    if node.type != "Cover":
        return node
    if not node.items or node.items[-1].type == "SpreadElement":
        raise Bad(f"an expression is missing at {node.start}")
    return node.items[0] if len(node.items) == 1 else Node("SequenceExpression", node.start, node.items)


def _as_pattern(node: Node) -> Node:
    """An expression read as the pattern that it turns out to be."""
    node = _uncovered(node)
    if node.type == "AssignmentExpression":
        return Node("AssignmentPattern", node.start, node.kids)
    if node.type == "ObjectExpression":
        own = [_as_pattern(p) for p in node.properties]
        return Node("ObjectPattern", node.start, own, properties=own)
    if node.type == "ObjectProperty":
        value = _as_pattern(node.value)
        return Node("ObjectProperty", node.start, [node.key, value], key=node.key, value=value)
    if node.type in ("ArrayExpression", "SpreadElement"):
        return Node("ArrayPattern" if node.type == "ArrayExpression" else "RestElement", node.start, [_as_pattern(k) for k in node.kids])
    return node


def parse(src: str) -> Node:
    """The tree of a source; Bad where it is no script."""
    return Parser(src).program()
