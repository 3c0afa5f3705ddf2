"""Facts of one Go file, as plain tuples; every rule over them is a DataFrame operation.

FACTS names the kinds and their Spark structs. A file that does not parse gives
an error text and no facts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

from strataq.frontend.golexer import GoSyntaxError, Lexed, normalised_lines
from strataq.frontend.goparser import N, parse, parses_as_body

FACTS = {
    "units": "element string, line int, tokens int, params int, complexity int, loc int, mccabe int, has_body boolean",
    "imports": "local_name string, path string, line int",
    "decls": "name string, word string, seq int",
    "refs": "qualifier string, name string, refs int",
    "locals": "decl int, name string",
    "literals": "element string, line int, value string",
    "comments": "grp int, line int, text string, element string, own_line boolean, code boolean, block_code string",
    "loops": "element string, line int, depth int, seq int",
    "loop_calls": "element string, line int, method string, root string, cursors array<string>, seq int",
    "loop_concats": "element string, line int, target string, known_string boolean",
    "branches": "element string, line int, empty boolean, has_else boolean",
    "switches": "element string, line int, kind string, tag string, has_default boolean, commented_arm boolean",
    "calls": "element string, line int, pkg string, name string",
    "exported": "element string, line int, word string, name string, documented boolean, receiver_exported boolean",
    "lines": "string",
}
SCHEMA = "package string, package_line int, loc int, error string, " + ", ".join(f"{k} array<{'string' if v == 'string' else f'struct<{', '.join(c.replace(' ', ': ', 1) for c in v.split(', '))}>'}>" for k, v in FACTS.items())

#: Calls whose result is a string.
STRING_PRODUCERS = frozenset(["Sprint", "Sprintf", "Sprintln", "Join", "Repeat", "String", "ToLower", "ToUpper", "TrimSpace"])
#: Fixed value: what a line of code looks like in a comment.
CODE_SHAPE = re.compile(r":=|^(?:if|for|switch|select|return|var|const|go|defer|func|case|break|continue)\b|^[}{]|\{$|^\w+(?:\.\w+)+\(|^\w+ = (?:\"|`|\w+[.(\[])", re.A)
SUMMARY = 90  # bytes of a comment or block that a description shows


def clip(text: str, most: int = SUMMARY) -> str:
    raw = text.encode()
    return text if len(raw) <= most else raw[: most - 3].decode(errors="ignore") + "..."


def root_name(e: N | None) -> str:
    """The name a chain of selectors, calls, indexes and parentheses starts from."""
    while e is not None and e.kind != "Ident":
        e = {"Selector": "x", "Index": "x", "Paren": "x", "Call": "fun"}.get(e.kind) and getattr(e, {"Call": "fun"}.get(e.kind, "x"))
    return e.name if e is not None else ""


def type_text(src: str, t: N) -> str:
    return re.sub(r"\s+", "", src[t.pos : t.end]).replace(",", ", ")


def element_of(src: str, d: N) -> str:
    return f"({type_text(src, d.recv[0].type)}).{d.name.name}" if d.recv else d.name.name


def mccabe(d: N) -> int:
    """One, and one per way on: branches, loops, cases that are not default, && and ||."""
    return _mccabe(d, d.nodes())


def _mccabe(d: N, nodes: list[N]) -> int:
    if d.body is None:
        return 0
    n = 1
    for x in nodes:
        k = x.kind
        if k == "Ident":
            continue
        n += k in ("If", "For", "Range") or k == "Case" and x.values is not None or k == "Comm" and x.comm is not None or k == "Binary" and x.op in ("&&", "||")
    return n


def count_params(d: N) -> int:
    return sum(max(1, len(f.names)) for f in d.params)


def _runs(e: N, seen: set[int]) -> int:
    """Runs of equal operators in a chain of && and || not parted by parentheses."""
    ops: list[str] = []

    def flatten(x: N) -> None:
        if x.kind == "Binary" and x.op in ("&&", "||"):
            seen.add(id(x))
            flatten(x.x)
            ops.append(x.op)
            flatten(x.y)

    flatten(e)
    return sum(1 for i, op in enumerate(ops) if not i or ops[i - 1] != op)


def cognitive(d: N) -> int:
    """Nesting-weighted complexity. Headers' init parts, range operands and select's communications add nothing."""
    if d.body is None:
        return 0
    name, seen, total = d.name.name, set(), 0
    todo: list[tuple[N, int]] = [(d.body, 0)]
    while todo:
        x, deep = todo.pop()
        k = x.kind
        if k == "If":
            total += 1 + deep
            step = x
            while True:
                todo += [(step.cond, deep), (step.body, deep + 1)]
                if step.other is None:
                    break
                total += 1
                if step.other.kind != "If":
                    todo.append((step.other, deep + 1))
                    break
                step = step.other
            continue
        if k in ("Switch", "TypeSwitch", "Select"):
            total += 1 + deep
            if k == "Switch" and x.tag is not None:
                todo.append((x.tag, deep))
            for c in x.body.list:
                todo += [(e, deep + 1) for e in [*((c.values or []) if c.kind == "Case" else []), *c.body]]
            continue
        if k == "For":
            total += 1 + deep
            todo += [(e, n) for e, n in ((x.cond, deep), (x.body, deep + 1)) if e is not None]
            continue
        if k == "Range":
            total += 1 + deep
            todo.append((x.body, deep + 1))
            continue
        if k == "FuncLit":
            todo.append((x.body, deep + 1))
            continue
        if k == "Branch":
            total += x.label is not None
        elif k == "Binary" and x.op in ("&&", "||") and id(x) not in seen:
            total += _runs(x, seen)
        elif k == "Call":
            f = x.fun
            total += f.kind == "Ident" and f.name == name or f.kind == "Selector" and f.sel.name == name
        todo += [(c, deep) for c in reversed(x.kids)]
    return total


def _local_names(d: N, nodes: list[N]) -> set[str]:
    """Names bound anywhere in a function; a binding hides a name in all of it."""
    out: set[str] = set()

    def fields(fs: list[N] | None) -> None:
        out.update(n.name for f in fs or [] for n in f.names)

    fields(d.recv), fields(d.params), fields(d.results)
    for x in nodes if d.body else ():
        if x.kind == "Ident":
            continue
        if x.kind == "Assign" and x.op == ":=":
            out.update(e.name for e in x.left if e.kind == "Ident")
        elif x.kind == "Range" and x.op == ":=":
            out.update(e.name for e in x.left if e.kind == "Ident")
        elif x.kind in ("ValueSpec",):
            out.update(n.name for n in x.names)
        elif x.kind == "TypeSpec":
            out.add(x.name.name)
        elif x.kind == "FuncLit":
            fields(x.type.params), fields(x.type.results)
    out.discard("_")
    return out


def _references(root: N) -> list[tuple[str | None, str]]:
    """(qualifier, name) of every name that may refer to a declaration. Keys, labels and field names do not."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        k = x.kind
        if k == "Ident":
            out.append((None, x.name))
        elif k == "Selector":
            if x.x.kind == "Ident":
                out.append((x.x.name, x.sel.name))
            else:
                todo.append(x.x)
        elif k == "KeyValue":
            todo += [x.value] if x.key.kind == "Ident" else [x.value, x.key]
        elif k == "Labeled":
            todo.append(x.stmt)
        elif k == "Field":
            todo.append(x.type)
        elif k != "Branch":
            todo.extend(reversed(x.kids))
    return out


def _produces_string(e: N) -> bool:
    if e.kind == "Lit":
        return e.lit == "string"
    if e.kind == "Binary":
        return e.op == "+" and (_produces_string(e.x) or _produces_string(e.y))
    if e.kind == "Call":
        return e.fun.kind == "Ident" and e.fun.name == "string" or e.fun.kind == "Selector" and e.fun.sel.name in STRING_PRODUCERS
    return False


def _string_names(nodes: list[N]) -> set[str]:
    out: set[str] = set()
    for x in nodes:
        if x.kind == "ValueSpec":
            if x.type is not None and x.type.kind == "Ident" and x.type.name == "string":
                out.update(n.name for n in x.names)
            out.update(n.name for n, v in zip(x.names, x.values) if _produces_string(v))
        elif x.kind == "Assign" and x.op == ":=":
            out.update(e.name for e, v in zip(x.left, x.right) if e.kind == "Ident" and _produces_string(v))
    return out


def unquote(text: str) -> str:
    if text[0] == "`":
        return text[1:-1].replace("\r", "")
    simple = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", '"': '"', "'": "'"}

    def one(m: re.Match) -> str:
        s = m.group(1)
        if s[0] in "xuU":
            return chr(min(int(s[1:], 16), 0x10FFFF))
        return chr(int(s, 8) & 255) if s[0].isdigit() else simple.get(s, s)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", one, text[1:-1])


class _Facts:
    def __init__(self, src: str):
        self.src = src
        self.tree, self.lex = parse(src)
        self.out: dict[str, list] = {k: [] for k in FACTS}
        comments = self.lex.comments
        self.doc_lines = {c.last_line: c for c in comments if c.own_line}

    def line(self, pos: int) -> int:
        return self.lex.line(pos)

    def documented(self, pos: int) -> bool:
        """A comment that begins its line ends on the line above."""
        return self.line(pos) - 1 in self.doc_lines

    def collect(self) -> dict[str, list]:
        src, line, out = self.src, self.line, self.out
        ranges: list[tuple[int, int, str]] = []
        functions: list[tuple[int, int, str]] = []
        free: Counter = Counter()
        for seq, d in enumerate(self.tree.decls):
            bound: set[str] = set()
            if d.kind == "FuncDecl":
                element = element_of(src, d)
                ranges.append((d.pos, d.end, element))
                functions.append(ranges[-1])
                nodes = d.nodes()
                self.function(d, element, nodes)
                if d.recv is None:
                    out["decls"].append((d.name.name, "func", seq))
                bound = _local_names(d, nodes)
                out["locals"] += [(seq, n) for n in sorted(bound)]
                if d.name.name[:1].isupper():
                    out["exported"].append((element, line(d.pos), "method" if d.recv is not None else "function", d.name.name, self.documented(d.pos), self.receiver_exported(d)))
            else:
                first = next((s for s in d.specs if s.kind != "ImportSpec"), None)
                if first is not None:
                    name = first.name if first.kind == "TypeSpec" else first.names[0]
                    ranges.append((d.pos, d.end, name.name))
                for s in d.specs:
                    if s.kind == "ImportSpec":
                        local = s.alias or s.path.rsplit("/", 1)[-1]
                        out["imports"].append((local, s.path, line(s.pos)))
                        continue
                    names = [s.name] if s.kind == "TypeSpec" else s.names
                    out["decls"] += [(n.name, d.word, seq) for n in names]
                    if names[0].name[:1].isupper():
                        out["exported"].append((names[0].name, line(s.pos), d.word, names[0].name, self.documented(d.pos) or d.grouped and self.documented(s.pos), True))
            free.update((q, n) for q, n in _references(d) if (n if q is None else q) not in bound)
        out["refs"] = [(q, n, k) for (q, n), k in free.items()]
        self.literals(functions)
        self.comment_rows(ranges)
        out["lines"] = normalised_lines(self.lex)
        return out

    @staticmethod
    def receiver_exported(d: N) -> bool:
        if not d.recv:
            return True
        t = d.recv[0].type
        t = t.x if t.kind == "Star" else t
        t = t.x if t.kind == "Index" else t
        return t.kind == "Ident" and t.name[:1].isupper()

    def function(self, d: N, element: str, nodes: list[N]) -> None:
        out, line, lex = self.out, self.line, self.lex
        written = lex.written(d.pos, d.end)
        lines = {t.line for t in written}
        out["units"].append((element, line(d.pos), len(written), count_params(d), cognitive(d), len(lines), _mccabe(d, nodes), d.body is not None))
        for x in nodes:
            if x.kind == "Call":
                f = x.fun
                if f.kind == "Ident":
                    out["calls"].append((element, line(x.pos), None, f.name))
                elif f.kind == "Selector" and f.x.kind == "Ident":
                    out["calls"].append((element, line(x.pos), f.x.name, f.sel.name))
            elif x.kind == "If" and d.body is not None:
                out["branches"].append((element, line(x.pos), not x.body.list, x.other is not None))
            elif x.kind in ("Switch", "TypeSwitch") and d.body is not None:
                self.switch(x, element)
        if d.body is not None:
            self.loops(d, element, nodes)

    def switch(self, x: N, element: str) -> None:
        tag = "type"
        if x.kind == "Switch":
            t = x.tag
            while t is not None and t.kind == "Paren":
                t = t.x
            tag = "none" if t is None else "call" if t.kind == "Call" else "value"
        has_default = commented = False
        for i, c in enumerate(x.body.list):
            if c.values is None:
                has_default = True
            elif not c.body:
                end = x.body.list[i + 1].pos if i + 1 < len(x.body.list) else x.body.close
                commented = commented or any(c.colon < k.pos < end for k in self.lex.comments)
        self.out["switches"].append((element, self.line(x.pos), "switch" if x.kind == "Switch" else "type switch", tag, has_default, commented))

    def loops(self, d: N, element: str, nodes: list[N]) -> None:
        if not any(x.kind in ("For", "Range") for x in nodes):
            return
        out, line, strings = self.out, self.line, _string_names(nodes)
        seq = [0]

        def visit(x: N, depth: int, cursors: tuple[str, ...]) -> None:
            k = x.kind
            if k == "FuncLit":
                visit(x.body, 0, cursors)
                return
            if k in ("For", "Range"):
                seq[0] += 1
                out["loops"].append((element, line(x.pos), depth, seq[0]))
                if k == "For" and x.cond is not None and x.cond.kind == "Call" and x.cond.fun.kind == "Selector" and x.cond.fun.sel.name == "Next":
                    cur = root_name(x.cond.fun.x)
                    cursors = (*cursors, cur) if cur else cursors
                visit(x.body, depth + 1, cursors)
                return
            if depth and k == "Call" and x.fun.kind == "Selector":
                seq[0] += 1
                out["loop_calls"].append((element, line(x.pos), x.fun.sel.name, root_name(x.fun.x), list(cursors), seq[0]))
            elif depth and k == "Assign" and len(x.left) == 1 and len(x.right) == 1 and x.left[0].kind == "Ident":
                t, r = x.left[0].name, x.right[0]
                if x.op == "+=" or x.op == "=" and r.kind == "Binary" and r.op == "+" and root_name(r.x) == t:
                    out["loop_concats"].append((element, line(x.pos), t, t in strings))
            for c in x.kids:
                visit(c, depth, cursors)

        visit(d.body, 0, ())

    def literals(self, ranges: list[tuple[int, int, str]]) -> None:
        tags = {x.tag.pos for x in self.tree.nodes() if x.kind == "Field" and getattr(x, "tag", None) is not None}
        imports = {t for d in self.tree.decls if d.kind == "GenDecl" and d.word == "import" for t in range(d.pos, d.end)}
        for t in self.lex.tokens:
            if t.kind == "string" and t.pos not in tags and t.pos not in imports:
                self.out["literals"].append((self.enclosing(ranges, t.pos), t.line, unquote(t.text)))

    @staticmethod
    def enclosing(ranges: list[tuple[int, int, str]], pos: int) -> str | None:
        """The declaration around a place; ranges do not overlap and come in order."""
        i = bisect_right(ranges, (pos, float("inf"), "")) - 1
        return ranges[i][2] if i >= 0 and pos < ranges[i][1] else None

    def comment_rows(self, ranges: list[tuple[int, int, str]]) -> None:
        groups: dict[int, list] = {}
        for c in self.lex.comments:
            groups.setdefault(c.group, []).append(c)
        for g, members in groups.items():
            element = self.enclosing(ranges, members[0].pos)
            block = code_block([c.text for c in members])
            for i, c in enumerate(members):
                self.out["comments"].append((g, c.line, c.text, element, c.own_line, block is None and is_code(c.text), block if i == 0 else None))


def comment_code(text: str) -> str | None:
    """What a // comment would be as code; None for samples, directives and empty ones."""
    if not text.startswith("//") or text[2:].startswith(("\t", "    ")):
        return None
    body = text[2:].strip()
    return None if not body or body.startswith(("go:", "nolint")) else body


def is_code(text: str) -> bool:
    body = comment_code(text)
    return body is not None and bool(CODE_SHAPE.search(body)) and parses_as_body(body)


def code_block(texts: list[str]) -> str | None:
    """A summary when two or more lines are code as a whole."""
    bodies = [comment_code(t) for t in texts]
    if len(texts) < 2 or None in bodies or not any(CODE_SHAPE.search(b) for b in bodies) or not parses_as_body("\n".join(bodies)):
        return None
    return clip(" ".join(bodies))


def go_facts(src: str | None) -> dict:
    """SCHEMA's fields of one file. A null text is as an empty one, which is no Go file and says so in error."""
    empty = {k: [] for k in FACTS}
    try:
        f = _Facts(src or "")
        return {"package": f.tree.package.name, "package_line": f.line(f.tree.package.pos), "loc": len({t.line for t in f.lex.written()}), "error": None, **f.collect()}
    except GoSyntaxError as e:
        return {"package": None, "package_line": None, "loc": None, "error": str(e), **empty}
    except RecursionError:
        return {"package": None, "package_line": None, "loc": None, "error": "nested too deeply", **empty}


def canonical_code(src: str) -> tuple[list[str], list[str]]:
    """(tokens, directives): two texts with equal pairs differ in comments and layout only. Raises GoSyntaxError."""
    _, lex = parse(src)
    return [t.text for t in lex.written()], sorted(c.text for c in lex.comments if is_directive(c.text))


_DIRECTIVE = re.compile(r"^//(?:[a-z0-9]+:[a-z0-9]|nolint(?:$|[: ])|line |extern |export )|^/\*line ")


def is_directive(text: str) -> bool:
    return bool(_DIRECTIVE.match(text))


__all__ = ["FACTS", "SCHEMA", "Lexed", "canonical_code", "go_facts"]
