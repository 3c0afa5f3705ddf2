"""Encoding chains: how text is garbled by a wrong decoding, and how that is undone."""

from __future__ import annotations

from functools import lru_cache

#: Fixed values: (encoding of the bytes, encoding they were read as), and such steps in a row.
_UTF8_READ_AS = "cp1252 latin-1 mac_roman cp1250 iso8859-2 iso8859-15 cp1251 cp1254 cp1257 koi8-r cp437 cp850 cp852 cp866 mac_latin2 mac_cyrillic gbk big5 cp949 cp932 euc_jp".split()
_OTHER_PAIRS = (
    "cp1252>mac_roman mac_roman>cp1252 mac_roman>latin-1 cp1252>cp437 cp1252>cp850 cp1252>cp852 cp437>cp1252 cp850>cp1252 cp437>latin-1 cp850>latin-1 cp1252>cp1250 cp1252>cp1251 cp1252>cp866 cp1252>koi8-r "
    "cp1250>cp1252 cp1250>latin-1 iso8859-2>cp1252 iso8859-2>latin-1 cp1250>cp852 cp852>cp1250 cp852>cp1252 cp852>latin-1 cp1250>iso8859-2 iso8859-2>cp1250 cp1250>mac_roman mac_latin2>cp1250 mac_latin2>cp1252 "
    "cp1251>cp1252 cp1251>latin-1 cp1251>koi8-r koi8-r>cp1251 cp1251>cp866 cp866>cp1251 koi8-r>cp866 cp866>koi8-r koi8-r>cp1252 koi8-r>latin-1 cp866>cp1252 cp866>latin-1 cp1251>mac_roman cp1251>mac_cyrillic mac_cyrillic>cp1251 "
    "euc_jp>cp1252 euc_jp>latin-1 cp932>cp1252 cp932>latin-1 cp932>mac_roman cp932>cp437 euc_jp>cp932 cp932>euc_jp cp932>gbk euc_jp>gbk cp932>cp1251 cp1252>gbk cp1252>big5 cp1252>cp949 cp1252>cp932"
).split()
_LOSSY = "cp1252>utf-8 mac_roman>utf-8 cp1250>utf-8 cp852>utf-8 cp1251>utf-8 koi8-r>utf-8 cp866>utf-8 cp932>utf-8 euc_jp>utf-8 utf-8>ascii".split()
_TWICE = [("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("mac_roman", "mac_roman"), ("cp1250", "cp1250"), ("cp850", "cp850"), ("cp437", "cp437")]

Chain = tuple[tuple[str, str], ...]
CHAINS: dict[str, Chain] = {f"utf-8>{w}": (("utf-8", w),) for w in _UTF8_READ_AS}
CHAINS |= {p: (tuple(p.split(">")),) for p in [*_OTHER_PAIRS, *_LOSSY]}
CHAINS |= {f"utf-8>{a}, utf-8>{b}": (("utf-8", a), ("utf-8", b)) for a, b in _TWICE}
NAMES = list(CHAINS)

_WIDE = frozenset({"utf-8", "gbk", "big5", "cp949", "cp932", "euc_jp", "ascii"})


@lru_cache(maxsize=64)
def _table(encoding: str) -> tuple[str, dict[int, int]]:
    """A one-byte encoding with its unused bytes read as control characters, and its inverse."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    inverse: dict[int, int] = {}
    for b, c in enumerate(chars):
        inverse.setdefault(ord(c), b)
    return "".join(chars), inverse


def _read(raw: bytes, encoding: str) -> str:
    if encoding in _WIDE:
        return raw.decode(encoding, "replace")
    return raw.decode("latin-1").translate(_table(encoding)[0])


def _raw(text: str, encoding: str) -> bytes | None:
    """The bytes that encoding reads as this text, or None."""
    try:
        if encoding in _WIDE:
            return text.encode(encoding)
        inverse = _table(encoding)[1]
        return bytes([inverse[ord(c)] for c in text])
    except (UnicodeEncodeError, KeyError):
        return None


def garble(text: str, chain: Chain) -> str | None:
    """The text after its bytes were read wrongly along the chain; None if the chain cannot write it."""
    for right, wrong in chain:
        try:
            text = _read(text.encode(right), wrong)
        except UnicodeEncodeError:
            return None
    return text


def restore(text: str, chain: Chain) -> str | None:
    """The text before the chain, strictly: every step must encode and decode without a fault."""
    for right, wrong in reversed(chain):
        raw = _raw(text, wrong) if wrong not in ("utf-8", "ascii") else None  # such steps lose bytes
        if raw is None:
            return None
        try:
            text = raw.decode(right)
        except UnicodeDecodeError:
            return None
    return text
