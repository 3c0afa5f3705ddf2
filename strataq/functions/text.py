"""Scalar predicates over text as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataq import dims


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def urls(text: Column) -> Column:
    """All URLs of a text, in order."""
    return F.regexp_extract_all(text, F.lit(dims.URL_PATTERN), F.lit(0))


def url_host(url: Column) -> Column:
    """The host in lower case, without scheme, user, port and what follows; an IPv6 host keeps its brackets."""
    rest = F.regexp_replace(url, r"^.*?://", "")
    rest = F.regexp_replace(rest, r"(?s)[/?#].*$", "")
    rest = F.regexp_replace(rest, r"^.*@", "")
    return F.lower(F.when(rest.contains("]"), F.regexp_replace(rest, r"\][^\]]*$", "]")).otherwise(F.regexp_replace(rest, r":[^:]*$", "")))


def host_allowed(host: Column, allowlist: list[str] = dims.URL_ALLOWLIST) -> Column:
    """Reserved names and listed hosts with their subdomains; an empty host is not."""
    names = [*dims.RESERVED_DOMAINS, *[n.removeprefix(".").lower() for n in allowlist]]
    listed = [(host == n) | host.endswith(f".{n}") for n in names if n]
    return (host != "") & any_of([host.endswith(f".{t}") for t in dims.RESERVED_TLDS] + listed)


def hardcoded_url(text: Column, allowlist: list[str] = dims.URL_ALLOWLIST) -> Column:
    """The first URL whose host is not allowed, else null."""
    return F.try_element_at(F.filter(urls(text), lambda u: ~host_allowed(url_host(u), allowlist)), F.lit(1))


def is_filesystem_path(text: Column) -> Column:
    """Whether a literal names a place in a file system. Limits count bytes."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    base = F.element_at(F.split(s, "/"), -1)
    rooted = any_of([s.startswith(f"/{d}/") for d in dims.FILESYSTEM_ROOTS])
    absolute = rooted | ((F.length(s) - F.length(F.replace(s, F.lit("/"))) >= 2) & base.contains("."))
    usable = (s != "") & (F.octet_length(s) <= 200) & ~s.rlike("[ \\t\\n\"'?<>{}|]") & ~s.rlike(dims.URL_PATTERN) & ~s.rlike(dims.MIME_TYPE)
    return usable & (s.rlike(dims.WINDOWS_PATH) | s.rlike(dims.HOME_PATH) | F.when(s.startswith("/"), absolute).otherwise(s.rlike(dims.RELATIVE_PATH)))


def trim_comment(text: Column) -> Column:
    """A comment without its marks, clipped to 90 bytes with an ellipsis."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^//", ""), r"^/\*", ""), r"^\s+|\s+$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\*/$", ""), r"^\s+|\s+$", "")
    return F.when(F.octet_length(body) > 90, F.concat(F.decode(F.substring(F.encode(body, "UTF-8"), 1, 87), "UTF-8"), F.lit("..."))).otherwise(body)


def normal_path(path: Column) -> Column:
    """Forward separators, no leading ./"""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def qualify(prefix: str, path: Column) -> Column:
    return F.concat(F.lit(prefix.rstrip("/") + "/"), path) if prefix else path


def folded_dir(directory: Column, depth: Column) -> Column:
    """The first parts of a directory; the root folds to an empty one."""
    return F.when(directory.isin(".", ""), F.lit("")).otherwise(F.array_join(F.slice(F.split(directory, "/"), 1, depth), "/"))


def version_parts(text: Column) -> Column:
    """A version's numbers as an array, without a leading v; null where there is none."""
    found = F.regexp_extract(text, r"v?(\d+(?:\.\d+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int")))


def same_version(text: Column, pin: Column) -> Column:
    """Equality, whether or not either side writes a leading v."""
    return F.regexp_replace(F.trim(text), "^v", "") == F.regexp_replace(F.trim(pin), "^v", "")


def at_least_version(text: Column, floor: Column) -> Column:
    """Part by part; parts that are missing count as 0."""
    a, b = version_parts(text), version_parts(floor)
    size = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0), size - F.size(x)))
    return pad(a) >= pad(b)


def share(part: Column, whole: Column) -> Column:
    """Per cent; 0 of nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


def rounded(value: Column, digits: int) -> Column:
    """Halves away from zero, on the scaled value."""
    x = value * float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) + 0.5) / float(10**digits)
