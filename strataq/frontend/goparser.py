"""A recursive-descent parser for Go files, after the language specification.

Nodes are N(kind, pos, end, kids, **parts): kids are the child nodes in source
order, parts name the ones a rule asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from strataq.frontend.golexer import GoSyntaxError, Lexed


class N:
    __slots__ = ("kind", "pos", "end", "kids", "__dict__")

    def __init__(self, kind: str, pos: int, end: int, kids: list, **parts: Any):
        self.kind, self.pos, self.end = kind, pos, end
        self.kids = [k for k in kids if k is not None] if None in kids else kids
        self.__dict__ = parts

    def walk(self) -> Iterator["N"]:
        return iter(self.nodes())

    def nodes(self) -> list["N"]:
        """The node and all below it, in source order."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            out.append(n)
            if n.kids:
                todo.extend(n.kids[::-1])
        return out


#: Binary operators by how tightly they bind.
PRECEDENCE = {op: i + 1 for i, ops in enumerate(("||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^")) for op in ops.split()}
ASSIGNING = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_LITERALS = frozenset(("int", "float", "imag", "char", "string"))


class Parser:
    def __init__(self, lexed: Lexed):
        self.lexed, self.toks, self.i, self.level = lexed, lexed.tokens, 0, 0
        self.kinds = [t.kind for t in self.toks]
        self.signs = [t.text if t.kind in ("op", "keyword") else "" for t in self.toks]

    # --- tokens

    @property
    def text(self) -> str:
        return self.signs[self.i]

    @property
    def kind(self) -> str:
        return self.kinds[self.i]

    @property
    def pos(self) -> int:
        return self.toks[self.i].pos

    @property
    def last_end(self) -> int:
        t = self.toks[self.i - 1]
        return t.pos + (0 if t.text == "\n" else len(t.text))

    def fail(self, want: str):
        t = self.toks[self.i]
        raise GoSyntaxError(f"line {self.lexed.line(t.pos)}: {t.text!r} where {want} was expected")

    def take(self, text: str) -> int:
        if self.text != text:
            self.fail(repr(text))
        self.i += 1
        return self.toks[self.i - 1].pos

    def got(self, text: str) -> bool:
        if self.signs[self.i] == text:
            self.i += 1
            return True
        return False

    def name(self) -> N:
        t = self.toks[self.i]
        if t.kind != "name":
            self.fail("a name")
        self.i += 1
        return N("Ident", t.pos, t.pos + len(t.text), [], name=t.text)

    def end_of_statement(self) -> None:
        if self.text in (";", "\n"):
            self.i += 1
        elif self.text not in (")", "}") and self.kind != "eof":
            self.fail("a line end")

    # --- file

    def file(self) -> N:
        while self.text in (";", "\n"):
            self.i += 1
        self.take("package")
        package = self.name()
        self.end_of_statement()
        decls = []
        while self.kind != "eof":
            if self.text in (";", "\n"):
                self.i += 1
                continue
            decls.append(self.function() if self.text == "func" else self.declaration(top=True))
            self.end_of_statement()
        return N("File", 0, self.pos, [package, *decls], package=package, decls=decls)

    def declaration(self, top: bool = False) -> N:
        word, pos = self.text, self.pos
        if word not in ("const", "var", "type", "import") or word == "import" and not top:
            self.fail("a declaration")
        self.i += 1
        read = {"const": self.value_spec, "var": self.value_spec, "type": self.type_spec, "import": self.import_spec}[word]
        specs = []
        grouped = self.got("(")
        if grouped:
            while self.text != ")":
                if self.text in (";", "\n"):
                    self.i += 1
                    continue
                specs.append(read(word))
                self.end_of_statement()
            self.i += 1
        else:
            specs.append(read(word))
        return N("GenDecl", pos, self.last_end, specs, word=word, specs=specs, grouped=grouped)

    def import_spec(self, _: str) -> N:
        pos, alias = self.pos, None
        if self.kind == "name":
            alias = self.name().name
        elif self.got("."):
            alias = "."
        t = self.toks[self.i]
        if t.kind != "string":
            self.fail("an import path")
        self.i += 1
        return N("ImportSpec", pos, self.last_end, [], alias=alias, path=t.text[1:-1])

    def value_spec(self, word: str) -> N:
        names, type_, values = [self.name()], None, []
        while self.got(","):
            names.append(self.name())
        if self.text not in ("=", ";", "\n", ")"):
            type_ = self.type()
        if self.got("="):
            values = self.expressions()
        return N("ValueSpec", names[0].pos, self.last_end, [*names, type_, *values], names=names, type=type_, values=values)

    def type_spec(self, _: str) -> N:
        name, params, start = self.name(), [], self.i
        if self.text == "[":
            try:
                params = self.type_parameters()
                if self.text in ("\n", ";", ")") or not params:
                    raise GoSyntaxError("an array type")
            except GoSyntaxError:
                self.i, params = start, []
        self.got("=")
        type_ = self.type()
        return N("TypeSpec", name.pos, self.last_end, [name, *params, type_], name=name, type=type_)

    def function(self) -> N:
        pos = self.take("func")
        recv = self.parameters() if self.text == "(" else None
        name = self.name()
        tparams = self.type_parameters() if self.text == "[" else []
        params = self.parameters()
        results = self.results()
        body = self.outer(self.block) if self.text == "{" else None
        return N("FuncDecl", pos, self.last_end, [*(recv or []), name, *tparams, *params, *results, body], recv=recv, name=name, params=params, results=results, body=body)

    # --- types

    def type_parameters(self) -> list[N]:
        self.take("[")
        out = []
        while self.text != "]":
            names = [self.name()]
            while self.got(","):
                names.append(self.name())
            bound = self.constraint()
            out.append(N("Field", names[0].pos, bound.end, [*names, bound], names=names, type=bound))
            if not self.got(","):
                break
        self.take("]")
        return out

    def constraint(self) -> N:
        left = self.constraint_term()
        while self.got("|"):
            right = self.constraint_term()
            left = N("Binary", left.pos, right.end, [left, right], op="|", x=left, y=right)
        return left

    def constraint_term(self) -> N:
        pos = self.pos
        if self.got("~"):
            t = self.type()
            return N("Unary", pos, t.end, [t], op="~", x=t)
        return self.type()

    def parameters(self) -> list[N]:
        """Fields; either all entries are named or none is."""
        self.take("(")
        entries: list[tuple[N | None, N]] = []
        while self.text != ")":
            if self.kind == "name" and self.toks[self.i + 1].text not in (",", ")", ".", "[") or self.kind == "name" and self.toks[self.i + 1].text == "[" and self._named_array():
                entries.append((self.name(), self.variadic()))
            else:
                entries.append((None, self.variadic()))
            if not self.got(","):
                break
        self.take(")")
        if not any(n for n, _ in entries):
            return [N("Field", t.pos, t.end, [t], names=[], type=t) for _, t in entries]
        out, names = [], []
        for n, t in entries:
            if n is None:
                if t.kind != "Ident":
                    raise GoSyntaxError("named and unnamed parameters together")
                names.append(t)
                continue
            names.append(n)
            out.append(N("Field", names[0].pos, t.end, [*names, t], names=names, type=t))
            names = []
        if names:
            raise GoSyntaxError("named and unnamed parameters together")
        return out

    def _named_array(self) -> bool:
        """Whether name [ ... starts a named parameter of array or slice type rather than a generic type."""
        start = self.i
        try:
            self.i += 1
            self.type()
            return self.text in (",", ")")
        except GoSyntaxError:
            return False
        finally:
            self.i = start

    def variadic(self) -> N:
        pos = self.pos
        if self.got("..."):
            t = self.type()
            return N("Ellipsis", pos, t.end, [t], type=t)
        return self.type()

    def results(self) -> list[N]:
        if self.text == "(":
            return self.parameters()
        if self.kind == "name" or self.text in ("*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            t = self.type()
            return [N("Field", t.pos, t.end, [t], names=[], type=t)]
        return []

    def type(self) -> N:
        t, pos = self.text, self.pos
        if self.kind == "name":
            return self.type_name()
        if t == "*":
            self.i += 1
            x = self.type()
            return N("Star", pos, x.end, [x], x=x)
        if t == "(":
            self.i += 1
            x = self.type()
            self.take(")")
            return N("Paren", pos, self.last_end, [x], x=x)
        if t == "[":
            self.i += 1
            size = None
            if self.text == "...":
                self.i += 1
            elif self.text != "]":
                size = self.outer(self.expression)
            self.take("]")
            x = self.type()
            return N("ArrayType", pos, x.end, [size, x], elem=x)
        if t == "map":
            self.i += 1
            self.take("[")
            k = self.type()
            self.take("]")
            v = self.type()
            return N("MapType", pos, v.end, [k, v])
        if t in ("chan", "<-"):
            self.i += 1
            if t == "<-":
                self.take("chan")
            else:
                self.got("<-")
            x = self.type()
            return N("ChanType", pos, x.end, [x])
        if t == "func":
            self.i += 1
            return self.signature(pos)
        if t == "struct":
            return self.struct()
        if t == "interface":
            return self.interface()
        self.fail("a type")

    def type_name(self) -> N:
        x = self.name()
        if self.text == ".":
            self.i += 1
            sel = self.name()
            x = N("Selector", x.pos, sel.end, [x, sel], x=x, sel=sel)
        if self.text == "[" and self.toks[self.i + 1].text != "]":
            start = self.i
            try:
                self.i += 1
                args = [self.type()]
                while self.got(","):
                    args.append(self.type())
                self.take("]")
                x = N("Index", x.pos, self.last_end, [x, *args], x=x)
            except GoSyntaxError:
                self.i = start
        return x

    def signature(self, pos: int) -> N:
        params, results = self.parameters(), self.results()
        return N("FuncType", pos, self.last_end, [*params, *results], params=params, results=results)

    def struct(self) -> N:
        pos = self.take("struct")
        self.take("{")
        fields = []
        while self.text != "}":
            if self.text in (";", "\n"):
                self.i += 1
                continue
            start = self.pos
            if self.text == "*" or self.kind == "name" and self.toks[self.i + 1].text in ("\n", ";", "}", ".") or self.kind == "name" and self.toks[self.i + 1].kind == "string" or self.kind == "name" and self.toks[self.i + 1].text == "[" and not self._array_field():
                t, names = self.type(), []
            else:
                names = [self.name()]
                while self.got(","):
                    names.append(self.name())
                t = self.type()
            tag = None
            if self.kind == "string":
                tag = self.toks[self.i]
                self.i += 1
            fields.append(N("Field", start, self.last_end, [*names, t], names=names, type=t, tag=tag))
            self.end_of_statement()
        self.take("}")
        return N("StructType", pos, self.last_end, fields, fields=fields)

    def _array_field(self) -> bool:
        start = self.i
        try:
            self.i += 1
            self.type()
            return self.text in ("\n", ";", "}") or self.kind == "string"
        except GoSyntaxError:
            return False
        finally:
            self.i = start

    def interface(self) -> N:
        pos = self.take("interface")
        self.take("{")
        fields = []
        while self.text != "}":
            if self.text in (";", "\n"):
                self.i += 1
                continue
            if self.kind == "name" and self.toks[self.i + 1].text == "(":
                n = self.name()
                t = self.signature(n.pos)
                fields.append(N("Field", n.pos, t.end, [n, t], names=[n], type=t))
            else:
                t = self.constraint()
                fields.append(N("Field", t.pos, t.end, [t], names=[], type=t))
            self.end_of_statement()
        self.take("}")
        return N("InterfaceType", pos, self.last_end, fields)

    # --- expressions

    def outer(self, read):
        """Read where a brace after a name starts a literal again."""
        level, self.level = self.level, 0
        try:
            return read()
        finally:
            self.level = level

    def expressions(self) -> list[N]:
        out = [self.expression()]
        while self.got(","):
            out.append(self.expression())
        return out

    def expression(self, least: int = 1) -> N:
        left = self.unary()
        while True:
            op = self.signs[self.i]
            binds = PRECEDENCE.get(op, 0)
            if binds < least:
                return left
            self.i += 1
            right = self.expression(binds + 1)
            left = N("Binary", left.pos, right.end, [left, right], op=op, x=left, y=right)

    def unary(self) -> N:
        op, pos = self.text, self.pos
        if op in ("+", "-", "!", "^", "&", "<-"):
            if op == "<-" and self.toks[self.i + 1].text == "chan":
                return self.primary(self.type())
            self.i += 1
            x = self.unary()
            return N("Unary", pos, x.end, [x], op=op, x=x)
        if op == "*":
            self.i += 1
            x = self.unary()
            return N("Star", pos, x.end, [x], x=x)
        return self.primary(self.operand())

    def operand(self) -> N:
        t = self.toks[self.i]
        if t.kind == "name":
            return self.name()
        if t.kind in _LITERALS:
            self.i += 1
            return N("Lit", t.pos, t.pos + len(t.text), [], lit=t.kind, value=t.text)
        if self.text == "(":
            self.i += 1
            x = self.outer(self.expression)
            self.take(")")
            return N("Paren", t.pos, self.last_end, [x], x=x)
        if self.text == "func":
            self.i += 1
            sig = self.signature(t.pos)
            if self.text == "{":
                body = self.outer(self.block)
                return N("FuncLit", t.pos, body.end, [sig, body], type=sig, body=body)
            return sig
        if self.text in ("[", "map", "chan", "struct", "interface"):
            return self.type()
        self.fail("an operand")

    def primary(self, x: N) -> N:
        while True:
            t = self.signs[self.i]
            if t == ".":
                self.i += 1
                if self.got("("):
                    if self.got("type"):
                        self.take(")")
                        x = N("TypeAssert", x.pos, self.last_end, [x], x=x, type=None)
                    else:
                        y = self.type()
                        self.take(")")
                        x = N("TypeAssert", x.pos, self.last_end, [x, y], x=x, type=y)
                else:
                    sel = self.name()
                    x = N("Selector", x.pos, sel.end, [x, sel], x=x, sel=sel)
            elif t == "[":
                x = self.outer(lambda x=x: self.index(x))
            elif t == "(":
                x = self.outer(lambda x=x: self.call(x))
            elif t == "{" and self._may_be_literal(x):
                x = self.outer(lambda x=x: self.literal(x))
            else:
                return x

    def _may_be_literal(self, x: N) -> bool:
        if x.kind in ("ArrayType", "MapType", "StructType"):
            return True
        base = x.x if x.kind == "Index" else x
        named = base.kind == "Ident" or base.kind == "Selector" and base.x.kind == "Ident"
        return named and self.level >= 0

    def index(self, x: N) -> N:
        self.take("[")
        parts: list[N | None] = [None]
        colons, commas = 0, 0
        while self.text != "]":
            if self.got(":"):
                colons += 1
                parts.append(None)
            elif self.got(","):
                commas += 1
                parts.append(None)
            else:
                parts[-1] = self.expression()
        self.take("]")
        return N("Slice" if colons else "Index", x.pos, self.last_end, [x, *parts], x=x)

    def call(self, x: N) -> N:
        self.take("(")
        args = []
        while self.text != ")":
            args.append(self.expression())
            self.got("...")
            if not self.got(","):
                break
        self.take(")")
        return N("Call", x.pos, self.last_end, [x, *args], fun=x, args=args)

    def literal(self, type_: N | None) -> N:
        pos = self.take("{")
        elements = []
        while self.text != "}":
            e = self.element()
            if self.got(":"):
                v = self.element()
                e = N("KeyValue", e.pos, v.end, [e, v], key=e, value=v)
            elements.append(e)
            if not self.got(","):
                break
        if self.text == "\n":
            self.fail("a comma")
        self.take("}")
        return N("CompositeLit", type_.pos if type_ else pos, self.last_end, [type_, *elements], type=type_)

    def element(self) -> N:
        return self.literal(None) if self.text == "{" else self.expression()

    # --- statements

    def block(self) -> N:
        pos = self.take("{")
        out = self.statements()
        close = self.take("}")
        return N("Block", pos, close + 1, out, list=out, close=close)

    def statements(self) -> list[N]:
        out = []
        while self.text not in ("}", "case", "default") and self.kind != "eof":
            if self.text in (";", "\n"):
                self.i += 1
                continue
            out.append(self.statement())
            if self.text not in ("}", "case", "default"):
                self.end_of_statement()
        return out

    def statement(self) -> N:
        t, pos = self.text, self.pos
        if t in ("const", "var", "type"):
            d = self.declaration()
            return N("DeclStmt", d.pos, d.end, [d])
        if t in ("go", "defer"):
            self.i += 1
            x = self.expression()
            if x.kind != "Call":
                raise GoSyntaxError(f"{t} needs a call")
            return N("Go" if t == "go" else "Defer", pos, x.end, [x])
        if t == "return":
            self.i += 1
            xs = [] if self.text in (";", "\n", "}") else self.expressions()
            return N("Return", pos, self.last_end, xs)
        if t in ("break", "continue", "goto", "fallthrough"):
            self.i += 1
            label = self.name() if self.kind == "name" and t != "fallthrough" else None
            return N("Branch", pos, self.last_end, [label], word=t, label=label)
        if t == "{":
            return self.block()
        if t == "if":
            return self.if_()
        if t == "switch":
            return self.switch()
        if t == "select":
            return self.select()
        if t == "for":
            return self.for_()
        if self.kind == "name" and self.toks[self.i + 1].text == ":" and self.toks[self.i + 1].kind == "op":
            label = self.name()
            self.i += 1
            while self.text == "\n":
                self.i += 1
            s = self.statement() if self.text != "}" else N("Empty", self.pos, self.pos, [])
            return N("Labeled", pos, s.end, [label, s], label=label, stmt=s)
        return self.simple()

    def simple(self, ranged: bool = False) -> N:
        left = self.expressions()
        t = self.text
        pos = left[0].pos
        if t in ASSIGNING:
            self.i += 1
            if ranged and t in ("=", ":=") and self.text == "range":
                self.i += 1
                x = self.expression()
                return N("RangeClause", pos, x.end, [*left, x], left=left, op=t, x=x)
            right = self.expressions()
            return N("Assign", pos, self.last_end, [*left, *right], left=left, op=t, right=right)
        if len(left) > 1:
            self.fail("an assignment")
        if t in ("++", "--"):
            self.i += 1
            return N("IncDec", pos, self.last_end, left)
        if t == "<-":
            self.i += 1
            x = self.expression()
            return N("Send", pos, x.end, [left[0], x])
        return N("ExprStmt", pos, left[0].end, left, x=left[0])

    def header(self, read):
        level, self.level = self.level, -1
        try:
            return read()
        finally:
            self.level = level

    def if_(self) -> N:
        pos = self.take("if")

        def head():
            init = None
            if self.text != ";":
                init = self.simple()
            if self.text in (";", "\n"):
                self.i += 1
                return init, self.simple()
            return None, init

        init, cond = self.header(head)
        if cond is None or cond.kind != "ExprStmt":
            raise GoSyntaxError("if needs a condition")
        body, other = self.outer(self.block), None
        if self.got("else"):
            if self.text not in ("if", "{"):
                self.fail("if or a block")
            other = self.if_() if self.text == "if" else self.outer(self.block)
        return N("If", pos, self.last_end, [init, cond.x, body, other], init=init, cond=cond.x, body=body, other=other)

    def switch(self) -> N:
        pos = self.take("switch")

        def head():
            init = tag = None
            if self.text != "{":
                if self.text != ";":
                    tag = self.simple()
                if self.text in (";", "\n"):
                    self.i += 1
                    init, tag = tag, None
                    if self.text != "{":
                        tag = self.simple()
            return init, tag

        init, tag = self.header(head)
        by_type = tag is not None and any(n.kind == "TypeAssert" and n.type is None for n in ((tag.x,) if tag.kind == "ExprStmt" else tag.right if tag.kind == "Assign" else ()))
        open_ = self.take("{")
        clauses = []
        while self.text != "}":
            if self.text in (";", "\n"):
                self.i += 1
                continue
            start, values = self.pos, None
            if self.got("case"):
                values = self.outer(self.expressions)
            else:
                self.take("default")
            colon = self.take(":")
            body = self.outer(self.statements)
            clauses.append(N("Case", start, self.last_end, [*(values or []), *body], values=values, body=body, colon=colon))
        close = self.take("}")
        body = N("Block", open_, close + 1, clauses, list=clauses, close=close)
        if by_type:
            return N("TypeSwitch", pos, close + 1, [init, tag, body], init=init, assign=tag, body=body)
        if tag is not None and tag.kind != "ExprStmt":
            raise GoSyntaxError("switch needs an expression")
        return N("Switch", pos, close + 1, [init, tag.x if tag else None, body], init=init, tag=tag.x if tag else None, body=body)

    def select(self) -> N:
        pos = self.take("select")
        open_ = self.take("{")
        clauses = []
        while self.text != "}":
            if self.text in (";", "\n"):
                self.i += 1
                continue
            start, comm = self.pos, None
            if self.got("case"):
                comm = self.outer(self.simple)
            else:
                self.take("default")
            self.take(":")
            body = self.outer(self.statements)
            clauses.append(N("Comm", start, self.last_end, [comm, *body], comm=comm, body=body))
        close = self.take("}")
        body = N("Block", open_, close + 1, clauses, list=clauses, close=close)
        return N("Select", pos, close + 1, [body], body=body)

    def for_(self) -> N:
        pos = self.take("for")

        def head():
            if self.text == "{":
                return None, None, None
            if self.text == "range":
                start = self.pos
                self.i += 1
                x = self.expression()
                return N("RangeClause", start, x.end, [x], left=[], op="", x=x)
            first = None if self.text == ";" else self.simple(ranged=True)
            if first is not None and first.kind == "RangeClause":
                return first
            if self.text not in (";", "\n"):
                return None, first, None
            self.i += 1
            cond = post = None
            if self.text != ";":
                cond = self.simple()
            if self.text not in (";", "\n"):
                self.fail("';'")
            self.i += 1
            if self.text != "{":
                post = self.simple()
            return first, cond, post

        got = self.header(head)
        body = self.outer(self.block)
        if isinstance(got, N):
            return N("Range", pos, body.end, [*got.left, got.x, body], left=got.left, op=got.op, x=got.x, body=body)
        init, cond, post = got
        if cond is not None and cond.kind != "ExprStmt":
            raise GoSyntaxError("for needs a condition")
        cond = cond.x if cond else None
        return N("For", pos, body.end, [init, cond, post, body], init=init, cond=cond, post=post, body=body)


def parse(src: str) -> tuple[N, Lexed]:
    """The file and its tokens; GoSyntaxError when it is none."""
    lexed = Lexed(src)
    return Parser(lexed).file(), lexed


def parses_as_body(text: str) -> bool:
    """Whether a text would stand as a function's body."""
    try:
        parse("package p\nfunc _() {\n" + text + "\n}\n")
        return True
    except (GoSyntaxError, RecursionError):
        return False
