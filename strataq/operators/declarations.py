"""Declarations made twice across files, and how much each matters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq import dims
from strataq.common import once, stash
from strataq.frontend.scriptfacts import arity_at, constants, exported, record_shapes, unions


_PAIRS = {"constants": ("name", "value"), "unions": ("label", "members"), "shapes": ("name", "fields"), "helpers": ("name", "arity")}
_KINDS = {
    "exports": pa.list_(pa.struct([("name", pa.string())])),
    "constants": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])),
    "unions": pa.list_(pa.struct([("label", pa.string()), ("members", pa.list_(pa.string()))])),
    "shapes": pa.list_(pa.struct([("name", pa.string()), ("fields", pa.list_(pa.string()))])),
    "helpers": pa.list_(pa.struct([("name", pa.string()), ("arity", pa.int32())])),
}
_SCHEMA = "rel string, exports array<struct<name: string>>, constants array<struct<name: string, value: string>>, unions array<struct<label: string, members: array<string>>>, shapes array<struct<name: string, fields: array<string>>>, helpers array<struct<name: string, arity: int>>"


def script_facts(files: DataFrame) -> DataFrame:
    """(rel, exports, constants, unions, shapes, helpers): all that a text declares, from one reading of it. helpers are of
    Go texts, the others of scripts. Texts are scanned by Python's engine: it has no depth that a string of a megabyte
    could exceed, as the JVM's has. Written once; unchanged files are not read again in a session."""
    read = {"exports": exported, "constants": constants, "unions": unions, "shapes": record_shapes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rels, texts = b.column("rel").to_pylist(), b.column("text").to_pylist()
            go = [r.endswith(".go") for r in rels]
            columns = {k: [[] if g else [{"name": x[0]} if k == "exports" else dict(zip(_PAIRS[k], x)) for x in f(t)] for g, t in zip(go, texts)] for k, f in read.items()}
            columns["helpers"] = [[dict(zip(_PAIRS["helpers"], x)) for x in arity_at(t)] if g else [] for g, t in zip(go, texts)]
            yield pa.RecordBatch.from_arrays([b.column("rel"), *[pa.array(columns[k], t) for k, t in _KINDS.items()]], names=["rel", *_KINDS])

    return once(files, "script-facts", lambda: stash(files.select("rel", "text").mapInArrow(run, _SCHEMA), "script-facts"))


def _extracted(files: DataFrame, kind: str) -> DataFrame:
    """(file, fields of the kind), of files with texts or of their script_facts()."""
    facts = files if kind in files.columns else script_facts(files)
    return facts.select(F.col("rel").alias("file"), F.inline(kind))


def _site(file: Column, name: Column) -> Column:
    return F.struct(file.alias("file"), name.alias("name"))


def exported_names(files: DataFrame) -> DataFrame:
    """(name, file) of exports; the further names of a one-line declaration count too."""
    return _extracted(files, "exports").distinct()


def duplicate_exports(files: DataFrame) -> DataFrame:
    """(name, files): names that two or more files export."""
    return exported_names(files).groupBy("name").agg(F.array_sort(F.collect_set("file")).alias("files")).where(F.size("files") > 1)


def repeated(rows: DataFrame, key: str, holds: Column) -> DataFrame:
    """The rows of the keys for which an aggregate condition holds: a class of any size stays rows and is never one list."""
    return rows.join(rows.groupBy(key).agg(holds.alias("_holds")).where("_holds").select(key), key, "left_semi")


def export_sites(files: DataFrame) -> DataFrame:
    """(name, file): duplicate_exports() as rows."""
    return repeated(exported_names(files), "name", F.count(F.lit(1)) > 1)


def value_sites(files: DataFrame) -> DataFrame:
    """(value, file, name): duplicate_values() as rows."""
    more = (F.count(F.lit(1)) > 1) & ((F.min("name") != F.max("name")) | (F.min("file") != F.max("file")))
    return repeated(string_constants(files), "value", more).select("value", "file", "name")


def sites_of_unions(files: DataFrame) -> DataFrame:
    """(members, file, name): duplicate_unions() as rows, members joined by |."""
    rows = union_sites(files).select(F.array_join("members", "|").alias("members"), "file", F.col("label").alias("name"))
    return repeated(rows, "members", F.count(F.lit(1)) > 1)


def string_constants(files: DataFrame) -> DataFrame:
    """(file, name, value) of constants bound to a string of four characters or more; a template with a substitution is none."""
    return _extracted(files, "constants").where(F.length("value") >= dims.MIN_VALUE_LENGTH)


def duplicate_values(files: DataFrame) -> DataFrame:
    """(value, sites): values bound more than once, under two names or in two files."""
    per = string_constants(files).groupBy("value").agg(F.array_sort(F.collect_list(_site(F.col("file"), F.col("name")))).alias("sites"), F.countDistinct("name").alias("_names"), F.countDistinct("file").alias("_files"))
    return per.where((F.size("sites") > 1) & ((F.col("_names") > 1) | (F.col("_files") > 1))).select("value", "sites")


def union_sites(files: DataFrame) -> DataFrame:
    """(file, label, members): unions of three or more string members, members sorted."""
    return _extracted(files, "unions").withColumn("members", F.array_sort("members"))


def duplicate_unions(files: DataFrame) -> DataFrame:
    """(members, sites): unions stated more than once."""
    return union_sites(files).groupBy("members").agg(F.array_sort(F.collect_list(_site(F.col("file"), F.col("label")))).alias("sites")).where(F.size("sites") > 1)


def contained_sets(sets: DataFrame, key: str, members: str) -> DataFrame:
    """(smaller, larger, missing): pairs of distinct sets where one holds all members of the other and more.

    No set meets every other. A set's rarest member selects its candidates, and
    they come from an equality join on the member: a superset has to hold it.
    """
    rows = sets.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(members)).alias("m"))
    single = rows.select("k", "m", F.explode("m").alias("x"))
    often = single.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    rarest = single.join(often, "x").groupBy("k", "m").agg(F.min_by("x", F.struct("n", "x")).alias("x")).select("x", F.col("k").alias("smaller"), F.col("m").alias("sm"))
    pairs = rarest.join(single.select("x", F.col("k").alias("larger"), F.col("m").alias("lm")), "x")
    kept = pairs.where((F.size("sm") < F.size("lm")) & (F.size(F.array_except("sm", "lm")) == 0))
    return kept.select("smaller", "larger", F.array_except("lm", "sm").alias("missing"))


def union_subsets(files: DataFrame) -> DataFrame:
    """(smaller_sites, larger_sites, missing): unions that another one widens."""
    sites = union_sites(files).groupBy("members").agg(F.array_sort(F.collect_list(_site(F.col("file"), F.col("label")))).alias("sites")).withColumn("key", F.array_join("members", "|"))
    pairs = contained_sets(sites, "key", "members")
    a = sites.select(F.col("key").alias("smaller"), F.col("sites").alias("smaller_sites"))
    b = sites.select(F.col("key").alias("larger"), F.col("sites").alias("larger_sites"))
    return pairs.join(a, "smaller").join(b, "larger").select("smaller_sites", "larger_sites", "missing")


def record_sites(files: DataFrame) -> DataFrame:
    """(file, name, fields) of interfaces and object types with four fields or more."""
    return _extracted(files, "shapes").where(F.size("fields") >= dims.MIN_FIELDS)


def duplicate_shapes(files: DataFrame) -> DataFrame:
    """(fields, sites): the same set of fields declared more than once."""
    keyed = record_sites(files).withColumn("fields", F.array_sort(F.array_distinct("fields")))
    return keyed.groupBy("fields").agg(F.array_sort(F.collect_list(_site(F.col("file"), F.col("name")))).alias("sites")).where(F.size("sites") > 1)


def go_helpers(files: DataFrame) -> DataFrame:
    """(name, file, package, arity) of unexported top-level functions; the arity of a list that never closes is null."""
    heads = _extracted(files, "helpers")
    # a file at the root has no directory; its name less the last letter stands for one, so each is on its own
    package = F.when(F.col("file").contains("/"), F.regexp_replace("file", r"/[^/]*$", "")).otherwise(F.expr("left(file, length(file) - 1)"))
    return heads.select("name", "file", package.alias("package"), "arity")


def duplicate_helpers(helpers: DataFrame, least: int = dims.MIN_PACKAGES) -> DataFrame:
    """(name, packages, files, reimplemented): names that `least` packages declare; reimplemented when they differ in arity."""
    per = helpers.groupBy("name").agg(F.countDistinct("package").alias("packages"), F.array_sort(F.collect_set("file")).alias("files"), (F.countDistinct("arity") > 1).alias("reimplemented"))
    return per.where(F.col("packages") >= least)


def tree_of(file: Column) -> Column:
    """The part of a repository a file lies in; parts cannot import each other."""
    inside = lambda d: file.rlike(rf"(?:^|/){d}/")
    return F.when(file.endswith(".go"), "go").when(inside("e2e"), "e2e").when(inside("server"), "server").when(inside("shared"), "shared").when(inside("scripts"), "scripts").otherwise("app")


def ranked(exports: DataFrame, values: DataFrame, unions: DataFrame, subsets: DataFrame, shapes: DataFrame, helpers: DataFrame, auto_import: list[str] = dims.AUTO_IMPORT_PATHS) -> DataFrame:
    """(check, title, sites, score, level, why): all findings in one list, the worst first."""
    none = F.lit(None).cast("array<string>")
    no = F.lit(False)
    named = lambda files, name: F.transform(files, lambda f: F.struct(f.alias("file"), name.alias("name")))
    suffix = lambda sites, word: F.transform(sites, lambda s: F.struct(s["file"].alias("file"), F.concat(s["name"], F.lit(f" ({word})")).alias("name")))
    row = lambda d, check, title, sites, missing=none, again=no, shared=none: d.select(F.lit(check).alias("check"), title.alias("title"), sites.alias("sites"), missing.alias("missing"), again.alias("reimplemented"), shared.alias("shared"))
    labels = lambda sites: F.transform(sites, lambda s: s["name"])
    both = F.array_sort(F.filter(F.array_intersect(labels(F.col("smaller_sites")), labels(F.col("larger_sites"))), lambda n: n.rlike("[a-z][A-Z]")))
    rows = row(values, "value", F.to_json(F.struct("value")), F.col("sites"))
    for other in (
        row(helpers, "godecl", F.concat("name", F.lit(" — declared in "), F.col("packages").cast("string"), F.lit(" packages")), named(F.col("files"), F.col("name")), again=F.col("reimplemented")),
        row(subsets, "subset", F.concat(F.lit("missing "), F.array_join("missing", ", ")), F.concat(suffix(F.col("smaller_sites"), "narrower"), suffix(F.col("larger_sites"), "wider")), F.col("missing"), shared=both),
        row(exports, "name", F.col("name"), named(F.col("files"), F.col("name"))),
        row(unions, "union", F.concat(F.size("members").cast("string"), F.lit(" members: "), F.array_join("members", " | ")), F.col("sites")),
        row(shapes, "shape", F.concat(F.lit("{"), F.array_join("fields", ", "), F.lit("}")), F.col("sites")),
    ):
        rows = rows.unionByName(other)
    return scored(rows, auto_import)


def scored(rows: DataFrame, auto_import: list[str] = dims.AUTO_IMPORT_PATHS) -> DataFrame:
    """rows (check, title, sites, missing, reimplemented, shared) with score, level and the reasons for it."""
    files = F.array_distinct(F.transform("sites", lambda s: s["file"]))
    trees = F.array_sort(F.array_distinct(F.transform(files, tree_of)))
    check, n, many = F.col("check"), F.size("files"), F.size("files") > 1
    auto = F.exists("files", lambda f: f.rlike("|".join(f"(?:{p})" for p in auto_import))) if auto_import else F.lit(False)
    shared_home = F.exists("files", lambda f: f.contains("/types/") | (tree_of(f) == "shared"))
    related = F.coalesce(F.size("shared"), F.lit(0)) > 0
    steps: list[tuple[Column, int, Column]] = [
        (check == "value", 6, F.lit("a duplicated VALUE fails at runtime with nothing to catch it")),
        (check == "subset", 3, F.concat(F.lit("inferred drift: the narrower copy cannot express "), F.array_join(F.coalesce("missing", F.array()), ", "))),
        ((check == "subset") & related, 3, F.concat(F.lit("same domain identifier ("), F.array_join(F.coalesce("shared", F.array()), ", "), F.lit(") on both sides, so one concept is diverging"))),
        (check == "name", 3, F.lit("one name, two declarations: the import site decides which")),
        (check == "godecl", 3, F.lit("one helper restated per package: a fix to one copy leaves the rest wrong")),
        ((check == "godecl") & F.col("reimplemented"), 2, F.lit("the copies do not even agree on an argument count, so these are re-implementations rather than copies")),
        ((check == "godecl") & (n >= 8), 2, F.concat(n.cast("string"), F.lit(" packages restate it, past the point the set is reviewable as a whole"))),
        (check.isin("union", "shape"), 2, F.lit("one vocabulary restated, so a change has to be made twice")),
        (~many, -2, F.lit("both in ONE file, so no other module can be misled")),
        (many & auto & (check == "name"), 3, F.lit("auto-import scope: a bare call binds one of them silently")),
        (many & (F.size("trees") > 1), 2, F.concat(F.lit("crosses "), F.array_join("trees", " / "), F.lit(", which cannot import each other"))),
        (many & (n >= 4), 2, F.concat(n.cast("string"), F.lit(" copies"))),
        (many & (n == 3), 1, F.lit("3 copies")),
        (many & shared_home, 1, F.lit("one copy sits in a types/shared module that should own it")),
    ]
    score = F.lit(0)
    for holds, points, _ in steps:
        score = score + F.when(holds, points).otherwise(0)
    why = F.array_compact(F.array(*[F.when(holds, reason) for holds, _, reason in steps]))
    level = F.lit("LOW")
    for least, name in reversed(dims.LEVELS):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    return rows.withColumn("files", files).withColumn("trees", trees).withColumn("score", score).withColumn("why", why).withColumn("level", level).select("check", "title", "sites", "score", "level", "why")


def in_rank(rows: DataFrame) -> DataFrame:
    """The worst first: score, number of sites, title in the order of a dictionary."""
    return rows.orderBy(F.col("score").desc(), F.size("sites").desc(), F.collate("title", "UNICODE"))

