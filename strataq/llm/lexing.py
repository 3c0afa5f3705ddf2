"""A lexer for Go, JavaScript, TypeScript and Vue scripts that keeps what delimits declarations.

It knows strings, templates, regular expressions and comments, and nothing of
declarations: whether a line declares something, what its name is and what it
belongs to is found over the rows. Tokens:
  o, c   an opening, a closing bracket
  h      the first word of a line on which a declaration may begin
  w      a word or sign after it, to the end of the line on which its parentheses close; of what stands
         in those only a Go receiver
  O, C   brackets among those
  k      a comment; adjoining // lines are one
Bracket pairs that close on their own line leave no token elsewhere.
"""

from __future__ import annotations

import re

GO, SCRIPT, VUE, OTHER = "go", "script", "vue", "other"

_EXT = {"go": GO, "ts": SCRIPT, "tsx": SCRIPT, "js": SCRIPT, "jsx": SCRIPT, "mjs": SCRIPT, "cjs": SCRIPT, "mts": SCRIPT, "cts": SCRIPT, "vue": VUE}
_NAMED = {"go": GO, "typescript": SCRIPT, "javascript": SCRIPT, "vue": VUE}


def language(file_name: str | None, code_language: str | None) -> str:
    """By the file's extension, else by the recorded language."""
    ext = (file_name or "").rsplit(".", 1)[-1].lower()
    return _EXT.get(ext) or _NAMED.get((code_language or "").strip().lower(), OTHER)


_FLAT = r"[(\[{][^()\[\]{}\"'`/\n]*[)\]}]"
_GO_TEXT = r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)+'"
_GO = re.compile(
    r"(?:\A|(?<=\n))[ \t]*(?P<h>func\b)"
    r"|(?P<line>//[^\n]*(?:\n[ \t]*//[^\n]*)*)|(?P<block>/\*.*?(?:\*/|\Z))"
    rf"|{_GO_TEXT}|{_FLAT}|(?P<o>[(\[{{])|(?P<c>[)\]}}])",
    re.S,
)
#: Words that may stand before a declaration's name.
_WORDS = r"(?:(?:public|private|protected|static|abstract|override|readonly|async|declare|accessor|get|set)[ \t]+)*"
_SCRIPT_TEXT = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}`]*\})*`|(?P<tick>`)|(?P<slash>/)"
_SCRIPT = re.compile(
    r"(?:\A|(?<=\n))[ \t]*(?:"
    r"(?P<h>(?=(?:(?:export|default|declare|async|abstract)[ \t]+)*(?:(?:function|class)\b(?![ \t]*\()|const[ \t]+[\w$]+[ \t]*(?=[:=])[^\n]*(?:=>|\bfunction\b|[=(\[{<,:|&][ \t\r]*(?:\n|\Z))))[\w$]+)"
    rf"|(?P<m>(?={_WORDS}\*?[ \t]*\#?[\w$]+\??[ \t]*(?:<[^();\n]*>)?\()[\w$#*]))"
    r"|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))"
    rf"|{_SCRIPT_TEXT}|(?P<e>\{{[^()\[\]{{}}\"'`/\n]*\}})|{_FLAT}|(?P<o>[(\[{{])|(?P<c>[)\]}}])",
    re.S,
)
_PAIR = r"(?P<pair>\([^()\[\]{}\"'`/\n]*\))"
_SIGNS = r"(?P<nl>\n)|(?P<w>[\w$#]+|=>|[=!<>]=+|&&|\|\||\?\?|[^\w\s$#])"
_GO_HEAD = re.compile(rf"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|{_GO_TEXT}|{_PAIR}|(?P<o>[(\[{{])|(?P<c>[)\]}}])|{_SIGNS}", re.S)
_SCRIPT_HEAD = re.compile(rf"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|{_SCRIPT_TEXT}|{_PAIR}|(?P<o>[(\[{{])|(?P<c>[)\]}}])|{_SIGNS}", re.S)
_RECEIVER = re.compile(r"[ \t]*\([^()\n]*\)")
_MEMBER = re.compile(r"[\w$#]+|[^\w\s$#]")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Signs and words after which a slash begins a regular expression.
_REGEX_AFTER = frozenset("(,=:[!&|?{};+-*%~^>")
_REGEX_WORDS = frozenset(["return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"])
_LAST_WORD = re.compile(r"[\w$]")
_VUE_SCRIPT = re.compile(r"<!--.*?-->|<script\b[^>]*>(?P<code>.*?)</script\s*>", re.S | re.I)

Token = tuple[int, int, int, int, str, str]  # first and last line, start, end, kind, text


def _template_end(body: str, at: int) -> int:
    """The position after the template that starts at `at`, with nested templates inside ${ }."""
    stack, i = ["`"], at + 1
    for m in re.compile(r"\\.|`|\$\{|\{|\}", re.S).finditer(body, i):
        x = m.group()
        if x[0] == "\\":
            continue
        if stack[-1] == "`":
            if x == "`":
                stack.pop()
                if not stack:
                    return m.end()
            elif x == "${":
                stack.append("}")
        elif x == "`":
            stack.append("`")
        elif x in ("{", "${"):
            stack.append("}")
        elif x == "}":
            stack.pop()
    return len(body)


def _own_line(body: str, at: int) -> bool:
    return not body[body.rfind("\n", 0, at) + 1 : at].strip()


def _regex_may_begin(code: str, at: int) -> bool:
    """Whether a slash at this place begins a regular expression: told by what stands before it, blanks and comments aside."""
    i = at
    while True:
        while i and code[i - 1].isspace():
            i -= 1
        if not code.endswith("*/", 0, i):
            break
        i = max(0, code.rfind("/*", 0, i))
    if not i:
        return True
    if code[i - 1] in _REGEX_AFTER:
        return True
    j = i
    while j and _LAST_WORD.match(code[j - 1]):
        j -= 1
    return code[j:i] in _REGEX_WORDS


class _Reader:
    """Tokens of one text, with line numbers kept up as it is read."""

    def __init__(self, code: str, base: int, line: int):
        self.code, self.base, self.line, self.last, self.out = code, base, line, 0, []

    def at(self, start: int) -> int:
        self.line += self.code.count("\n", self.last, start)
        self.last = start
        return self.line

    def add(self, start: int, end: int, kind: str, text: str) -> None:
        line = self.at(start)
        self.out.append((line, line, self.base + start, self.base + end, kind, text))

    def comment(self, start: int, end: int) -> None:
        line = self.at(start)
        self.out.append((line, line + self.code.count("\n", start, end), self.base + start, self.base + end, "k", self.code[start:end]))

    def skip(self, kind: str, start: int, end: int) -> int:
        """The end of a template or regular expression; a slash that divides ends where it is."""
        if kind == "tick":
            return _template_end(self.code, start)
        r = _REGEX.match(self.code, start)
        return r.end() if r and _regex_may_begin(self.code, start) else end

    def words(self, start: int, end: int) -> None:
        for x in _MEMBER.finditer(self.code, start, end):
            text = x.group()
            self.add(x.start(), x.end(), "O" if text == "(" else "C" if text == ")" else "w", text)

    def head(self, pattern: re.Pattern, end: int) -> int:
        """The tokens to the end of the line on which the parentheses open here are closed, also past a line that ends
        with =; of what stands in parentheses or square brackets nothing."""
        inside, text = 0, ""
        m = pattern.search(self.code, end)
        while m:
            kind, start, end = m.lastgroup, m.start(), m.end()
            if kind == "nl":
                if not inside and text != "=":
                    return start
            elif kind == "o" or kind == "c":
                text = m.group()
                if inside:
                    inside += 1 if kind == "o" else -1
                elif text in "([":
                    inside = 1
                if kind == "o" and inside <= 1 or kind == "c" and not inside:
                    self.add(start, end, kind.upper(), text)
            elif kind == "tick" or kind == "slash":
                end, text = self.skip(kind, start, end), ""
            elif kind == "line" or kind == "block":
                if kind == "block" and _own_line(self.code, start):
                    self.comment(start, end)
            elif not inside:
                text = ")" if kind == "pair" else m.group()
                if kind == "w":
                    self.add(start, end, "w", text)
                elif kind == "pair":
                    self.add(start, start + 1, "O", "(")
                    self.add(end - 1, end, "C", ")")
            m = pattern.search(self.code, end)
        return len(self.code)


def lex_go(body: str) -> list[Token]:
    r = _Reader(body, 0, 1)
    m = _GO.search(body)
    while m:
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "c" or kind == "o":
            r.add(start, end, kind, m.group())
        elif kind == "h":
            r.add(m.start("h"), end, "h", "func")
            receiver = _RECEIVER.match(body, end)
            if receiver:
                r.words(end, receiver.end())
                end = receiver.end()
            end = r.head(_GO_HEAD, end)
        elif kind is not None:
            if not _own_line(body, start):  # a remark on code; // lines below it stand for themselves
                cut = body.find("\n", start, end) if kind == "line" else end
                start = end if cut < 0 else cut + 1
            if start < end:
                r.comment(start, end)
        m = _GO.search(body, end)
    return r.out


def lex_script(body: str, base: int = 0, stop: int | None = None) -> list[Token]:
    code = body if stop is None else body[base:stop]
    r = _Reader(code, base, 1 + (body.count("\n", 0, base) if base else 0))
    member = -1
    m = _SCRIPT.search(code)
    while m:
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "o" or kind == "c":
            r.add(start, end, kind, m.group())
        elif kind == "e":  # a pair in one piece counts only where it may be a method's body
            if member >= 0 and code.find("\n", member, start) < 0:
                r.add(start, start + 1, "o", "{")
                r.add(end - 1, end, "c", "}")
            else:
                member = -1
        elif kind == "h":
            r.add(m.start("h"), end, "h", m.group("h"))
            end = r.head(_SCRIPT_HEAD, end)
        elif kind == "m":  # words up to the parenthesis, which is read again as a bracket
            at, mark = m.start("m"), "h"
            for x in _MEMBER.finditer(code, at):
                r.add(x.start(), x.end(), mark, x.group())
                mark, end = "w", x.start()
                if x.group() == "(":
                    break
            member = end
        elif kind == "line" or kind == "block":
            if _own_line(code, start):
                r.comment(start, end)
        elif kind == "tick" or kind == "slash":
            end = r.skip(kind, start, end)
        m = _SCRIPT.search(code, end)
    return r.out


def lex(body: str | None, file_name: str | None, code_language: str | None) -> list[Token]:
    """Tokens in order of their place; none for a null or empty body or another language."""
    if not body:
        return []
    kind = language(file_name, code_language)
    if kind == GO:
        return lex_go(body)
    if kind == SCRIPT:
        return lex_script(body)
    if kind == VUE:
        return [t for m in _VUE_SCRIPT.finditer(body) if m.group("code") for t in lex_script(body, m.start("code"), m.end("code"))]
    return []
