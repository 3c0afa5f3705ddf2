"""What script and Go texts declare, without parsing them."""

from __future__ import annotations

import re

_HEAD = re.compile(r"(?:export\s+)?(?:interface\s+([A-Za-z_$][\w$]*)[^{]*|type\s+([A-Za-z_$][\w$]*)\s*=\s*)\{")
_FIELD = re.compile(r"\s*(?:readonly\s+)?([A-Za-z_$][\w$]*)\s*\??\s*:")
#: FIXED VALUES: what declarations look like; valid in RE2 as well.
DECLARED = r"(?m)^[ \t]*export[ \t]+(?:async[ \t]+)?(?:function|const|let|class|interface|type|enum)[ \t]+([A-Za-z_$][\w$]*)"
DECLARED_MORE = r"(?m)^[ \t]*export[ \t]+(?:const|let)[ \t]+[A-Za-z_$][\w$]*[ \t]*=[^,;(\[{\n]*((?:,[ \t]*[A-Za-z_$][\w$]*[ \t]*=[^,;(\[{\n]*)+)$"
NEXT_NAME = r",[ \t]*([A-Za-z_$][\w$]*)[ \t]*="
_CONSTANT = re.compile(r"^[ \t]*(?:export[ \t]+)?const[ \t]+([A-Za-z_$][\w$]*)(?:\s*:\s*[^=]+)?\s*=\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|`((?:[^`\\]|\\.)*)`)", re.M | re.A)
_UNION = re.compile(r"(?:type\s+([A-Za-z_$][\w$]*)\s*=|([A-Za-z_$][\w$]*)\s*\??\s*:)\s*((?:'[^']+'|\"[^\"]+\")(?:\s*\|\s*(?:'[^']+'|\"[^\"]+\")){2,})", re.A)
_MEMBER = re.compile(r"'([^']+)'|\"([^\"]+)\"")
_DECLARED, _MORE, _NEXT = (re.compile(p, re.A) for p in (DECLARED, DECLARED_MORE, NEXT_NAME))
_GO_FUNC = re.compile(r"^func[ \t]+([a-z]\w*)[ \t]*(?:\[(?:[^\[\]]|\[[^\[\]]*\])*\])?\(", re.M | re.A)


def _parts(text: str, at: int, open_: str, close: str, ends: str) -> tuple[list[str], bool]:
    """What lies between the bracket just before `at` and its partner, cut at the separators directly inside; whether the partner came."""
    depth, start, parts = 1, at, []
    for m in re.compile(f"[{re.escape(open_ + close + ends)}]").finditer(text, at):
        c = m.group()
        if c in open_:
            depth += 1
        elif c in close:
            depth -= 1
            if not depth:
                return [*parts, text[start : m.start()]], True
        elif depth == 1:
            parts.append(text[start : m.start()])
            start = m.end()
    return parts, False


def record_shapes(text: str | None) -> list[tuple[str, list[str]]]:
    """(name, fields) of each interface or object type, nested ones apart."""
    out = []
    at = 0
    while m := _HEAD.search(text or "", at):
        parts, _ = _parts(text, m.end(), "{", "}", "\n;,")
        fields = [f.group(1) for p in parts if (f := _FIELD.match(p))]
        out.append((m.group(1) or m.group(2), fields))
        at = m.end()
    return out


def arity_at(text: str | None) -> list[tuple[str, int | None]]:
    """(name, number of parameters) of Go functions with a small first letter; None where the list never closes."""
    out = []
    for m in _GO_FUNC.finditer(text or ""):
        parts, closed = _parts(text, m.end(), "([{", ")]}", ",")
        out.append((m.group(1), None if not closed else len(parts) if any(p.strip() for p in parts) else 0))
    return out


def exported(text: str | None) -> list[tuple[str]]:
    """Exported names, those of one-line declarations of several included."""
    text = text or ""
    return [(m.group(1),) for m in _DECLARED.finditer(text)] + [(n,) for m in _MORE.finditer(text) for n in _NEXT.findall(m.group(1))]


def constants(text: str | None) -> list[tuple[str, str]]:
    """(name, value) of constants bound to a string literal."""
    out = []
    for m in _CONSTANT.finditer(text or ""):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        if m.group(4) is None or "${" not in value:
            out.append((m.group(1), value))
    return out


def unions(text: str | None) -> list[tuple[str, list[str]]]:
    """(label, members) of unions of three or more string members."""
    return [(m.group(1) or m.group(2), [a or b for a, b in _MEMBER.findall(m.group(3))]) for m in _UNION.finditer(text or "")]
