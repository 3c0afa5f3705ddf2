"""The front end over DataFrames: one parse per file, every fact table from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from strataq.common import once, stash
from strataq.frontend.gofacts import FACTS, SCHEMA, go_facts

_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_FILE = [("package", pa.string()), ("package_line", pa.int32()), ("loc", pa.int32()), ("error", pa.string())]


def _column(kind: str, files: list[dict]) -> pa.Array:
    """One fact of many files as a list column, built field by field."""
    lists = [f[kind] for f in files]
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    rows = [row for x in lists for row in x]
    if FACTS[kind] == "string":
        values = pa.array(rows, pa.string())
    else:
        fields = [f.split(" ", 1) for f in FACTS[kind].split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(fields)
        values = pa.StructArray.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], fields=[pa.field(n, _TYPES[t]) for n, t in fields])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def parse_go(files: DataFrame, strict: bool = False) -> DataFrame:
    """(module, rel, dir, file facts ...) of Go files, written once so that every rule reads it and none parses again.

    A file that does not parse keeps its row with error set and no facts; with
    strict it fails the scan. Texts are dropped here and do not travel on. The
    same files, unchanged, are parsed once in a session.
    """
    schema = f"module string, rel string, dir string, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts = []
            for rel, body in zip(b.column("rel"), b.column("body")):
                facts.append(go_facts(body.as_py()))
                if strict and facts[-1]["error"]:
                    raise ValueError(f"{rel.as_py()}: {facts[-1]['error']}")
            columns = [b.column(c) for c in ("module", "rel", "dir")] + [pa.array([f[c] for f in facts], t) for c, t in _FILE] + [_column(k, facts) for k in FACTS]
            yield pa.RecordBatch.from_arrays(columns, names=["module", "rel", "dir", *[c for c, _ in _FILE], *FACTS])

    parsed = files.select("module", "rel", "dir", "body").mapInArrow(run, schema)
    return once(files, f"go-facts-{strict}", lambda: stash(parsed, "go-facts"))


def fact(parsed: DataFrame, kind: str) -> DataFrame:
    """One fact table: (module, rel, dir, fields of the fact)."""
    if kind == "lines":
        return parsed.select("module", "rel", "dir", F.posexplode("lines").alias("i", "line_text"))
    return parsed.select("module", "rel", "dir", F.inline(kind))


@udtf(returnType="element string, line int, tokens int, params int, complexity int, loc int, mccabe int, has_body boolean")
class ParseUnits:
    """units of one source text, for SQL: SELECT * FROM t, LATERAL parse_units(t.body)."""

    def eval(self, body: str):
        yield from go_facts(body)["units"]


def register(spark) -> None:
    """Makes the front end callable from SQL as parse_units; other languages register a table function of their own."""
    spark.udtf.register("parse_units", ParseUnits)
