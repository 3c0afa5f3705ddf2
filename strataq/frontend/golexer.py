"""Go tokens, with the semicolons that line ends imply, and comments apart."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple


class GoSyntaxError(ValueError):
    pass


class Token(NamedTuple):
    kind: str  # name, keyword, int, float, imag, char, string, op, eof
    text: str
    pos: int
    line: int


class Comment(NamedTuple):
    text: str
    pos: int
    line: int
    last_line: int
    own_line: bool  # nothing but blanks before it on its line
    group: int


#: The language's keywords.
KEYWORDS = frozenset(["break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var"])
_SCAN = re.compile(
    r"[ \t\r]*(?:(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<num>0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`)|(?P<char>'(?:[^'\\\n]|\\[^\n][^'\n]*)')"
    r"|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~])|(?P<end>\Z))",
    re.S,
)
_ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())


class Lexed:
    """tokens (implied semicolons have the text '\\n'), comments, and lines of offsets."""

    def __init__(self, src: str):
        self.src = src
        self.starts = [0, *(m.end() for m in re.finditer("\n", src))]
        self.tokens: list[Token] = []
        self.comments: list[Comment] = []
        at, n, ends, group, last_token_line, line, written = 0, len(src), False, -1, 0, 1, 0
        tokens, previous, scan, make = self.tokens, None, _SCAN.match, tuple.__new__
        while at < n:
            m = scan(src, at)
            if m is None:
                raise GoSyntaxError(f"unexpected {src[at:].lstrip()[:1]!r} at line {self.line(at)}")
            kind = m.lastgroup
            pos, at = m.span(kind)
            if kind == "nl":
                if ends:
                    tokens.append(make(Token, ("op", "\n", pos, line)))
                    ends = False
                line += 1
                continue
            text = src[pos:at]
            if kind == "name":
                if text in KEYWORDS:
                    kind, ends = "keyword", text in _ENDS
                else:
                    ends = True
            elif kind == "op":
                ends = text in _ENDS
            elif kind == "line" or kind == "block":
                last = line + (text.count("\n") if kind == "block" else 0)
                if ends and (kind == "line" or last > line):
                    tokens.append(make(Token, ("op", "\n", pos, line)))
                    ends = False
                trailing = written > 0 and last_token_line == line
                if previous is None or previous[0] != written or line > previous[1] + 1 or (previous[2] and line > previous[1]):
                    group += 1
                self.comments.append(Comment(text.rstrip("\r"), pos, line, last, not src[self.starts[line - 1] : pos].strip(), group))
                previous, line = (written, last, trailing), last
                continue
            elif kind == "end":
                break
            else:
                ends = True
                if kind == "num":
                    kind = "imag" if text[-1] == "i" else "float" if re.search(r"\.|[eE](?!.*[xX])|[pP]", text if text[:2].lower() != "0x" else re.sub(r"[eE]", "", text)) else "int"
            tokens.append(make(Token, (kind, text, pos, line)))
            written += 1
            if kind == "string" and text[0] == "`":
                line += text.count("\n")
            last_token_line = line
        if ends:
            tokens.append(Token("op", "\n", n, line))
        tokens.append(Token("eof", "", n, line))
        self._positions = [t.pos for t in tokens]

    def line(self, pos: int) -> int:
        return bisect_right(self.starts, pos)

    def written(self, start: int = 0, end: int | None = None) -> list[Token]:
        """Tokens of a span that stand in the text."""
        first = bisect_left(self._positions, start)
        last = len(self.tokens) if end is None else bisect_left(self._positions, end)
        return [t for t in self.tokens[first:last] if t.text != "\n" and t.kind != "eof"]


def normalised_lines(lexed: Lexed) -> list[str]:
    """Per line on which a token starts, its tokens' texts joined by a blank."""
    by_line: dict[int, list[str]] = {}
    for t in lexed.written():
        by_line.setdefault(t.line, []).append(t.text)
    return [" ".join(by_line[k]) for k in sorted(by_line)]
