"""References between files: resolution, dependency volume and span, fan-in, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators.facts import fact


def import_path() -> Column:
    """A package's path: the module, and the directory below it."""
    return F.when(F.col("dir") == ".", F.col("module")).otherwise(F.concat_ws("/", "module", "dir"))


def declarations(parsed: DataFrame) -> DataFrame:
    """(import_path, name, target): which file declares a package's name. Of several the last file holds."""
    return fact(parsed, "decls").withColumn("import_path", import_path()).groupBy("module", "import_path", "name").agg(F.max("rel").alias("target"))


def met_references(parsed: DataFrame) -> DataFrame:
    """(module, rel, target, coarse, sibling, refs): counted references of each file to other files or packages, a row for each name.

    A qualified name refers to what its file imports under the qualifier; within
    a scanned package it is the declaring file, else the package. A bare name, or
    a qualifier that is no import, refers to a sibling file's declaration, unless
    the file itself declares it. Names that a function binds are no references;
    the front end counts the others per file and name, so that a name used a
    million times is one row, and every reference meets the declarations in one join.
    """
    imports = F.filter("imports", lambda i: (i["local_name"] == F.col("qualifier")) & ~i["local_name"].isin("_", "."))
    rows = parsed.select("module", "rel", import_path().alias("own_path"), "imports", F.inline("refs"))
    path = F.when(F.col("qualifier").isNotNull(), F.try_element_at(imports, F.lit(-1))["path"])  # of several the last holds
    rows = rows.withColumn("coarse", path).select(
        "module", "rel", "coarse", "refs",
        F.coalesce("coarse", "own_path").alias("import_path"),
        F.when(F.col("coarse").isNull(), F.coalesce("qualifier", "name")).otherwise(F.col("name")).alias("name"),
    )
    met = rows.join(declarations(parsed), ["module", "import_path", "name"], "left")
    sibling = F.col("coarse").isNull()
    return met.where(~sibling | F.col("target").isNotNull() & (F.col("target") != F.col("rel"))).select(
        "module", "rel", F.coalesce("target", "coarse").alias("target"), F.coalesce("coarse", "target").alias("coarse"), sibling.alias("sibling"), "refs"
    )


def resolved_references(parsed: DataFrame) -> DataFrame:
    """met_references() with one row for each file and target."""
    return met_references(parsed).groupBy("module", "rel", "target", "coarse", "sibling").agg(F.sum("refs").alias("refs"))


def file_dependencies(parsed: DataFrame, refs: DataFrame, granularity: str = "package") -> DataFrame:
    """(module, rel, line, volume, volume_local, volume_cross, span, targets); a file without references has zeros."""
    target = "coarse" if granularity == "package" else "target"
    per = refs.groupBy("module", "rel").agg(
        F.sum("refs").alias("volume"), F.sum(F.when(F.col("sibling"), F.col("refs")).otherwise(0)).alias("volume_local"), F.sum(F.when(~F.col("sibling"), F.col("refs")).otherwise(0)).alias("volume_cross"), F.array_sort(F.collect_set(target)).alias("targets")
    )
    files = parsed.where("error IS NULL").select("module", "rel", F.col("package_line").alias("line"))
    zero = ["volume", "volume_local", "volume_cross"]
    return files.join(per, ["module", "rel"], "left").fillna(0, zero).select("module", "rel", "line", *zero, F.coalesce(F.size("targets"), F.lit(0)).alias("span"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def module_dependencies(refs: DataFrame, members: DataFrame) -> DataFrame:
    """(module, source, target, refs) between scanned files; packages and files outside drop out."""
    inside = members.select("module", F.col("rel").alias("target"))
    return refs.where("target <> rel").join(inside, ["module", "target"], "left_semi").groupBy("module", F.col("rel").alias("source"), "target").agg(F.sum("refs").alias("refs"))


def owners(paths: DataFrame, file: str, components: DataFrame) -> DataFrame:
    """paths with component: that of the longest component path which is the file or a directory above it; null where none is.

    Every directory above a file is a row, joined by equality: no prefix test
    meets every pair, however large the map is.
    """
    parts = F.split("_file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = paths.select(F.col(file).alias("_file")).distinct().select("_file", F.explode(above).alias("path"))
    best = steps.join(components.select("component", "path"), "path").groupBy("_file").agg(F.max_by("component", F.length("path")).alias("component"))
    return paths.join(best, F.col(file) == F.col("_file"), "left").drop("_file")


def fan_in(dependencies: DataFrame, source: str, target: str, refs: str, source_component: str | None = None, target_component: str | None = None) -> DataFrame:
    """(target, in_modules, in_refs[, in_cross_component]): distinct sources and references; pairs are made distinct first, so a target of many sources is counted in parts."""
    keys = [source, target, *[c for c in (source_component, target_component) if c]]
    pairs = dependencies.groupBy(*keys).agg(F.sum(refs).alias("_refs"))
    out = [F.count(F.lit(1)).alias("in_modules"), F.sum("_refs").alias("in_refs")]
    if source_component and target_component:
        out.append(F.count_if(~F.col(source_component).eqNullSafe(F.col(target_component))).alias("in_cross_component"))
    return pairs.groupBy(target).agg(*out)


def measured_modules(files: DataFrame, file: str, incoming: DataFrame, target: str) -> DataFrame:
    """files with their fan-in; a file nobody refers to has zeros."""
    counts = [c for c in ("in_modules", "in_refs", "in_cross_component") if c in incoming.columns]
    return files.join(incoming.withColumnRenamed(target, file), file, "left").fillna(0, counts)


def component_edges(dependencies: DataFrame, source_component: str, target_component: str, source: str, target: str) -> DataFrame:
    """(from, to, weight): distinct pairs of files across two components."""
    pairs = dependencies.where(F.col(source_component) != F.col(target_component)).select(F.col(source_component).alias("from"), F.col(target_component).alias("to"), source, target).distinct()
    return pairs.groupBy("from", "to").agg(F.count(F.lit(1)).alias("weight"))


def independence(modules: DataFrame, floor: float) -> DataFrame:
    """One row: hidden and total lines, share, pass, lines too many in the open. A module is hidden when no other component refers to it. No lines give no row."""
    hidden = F.col("in_cross_component") == 0
    one = modules.agg(F.sum(F.when(hidden, F.col("loc")).otherwise(0)).alias("hidden_loc"), F.sum("loc").alias("total_loc")).where("total_loc > 0")
    pct = F.col("hidden_loc") / F.col("total_loc") * 100
    return one.select("hidden_loc", "total_loc", pct.alias("pct"), F.lit(floor).alias("floor_pct"), (pct >= floor).alias("pass"), F.when(pct >= floor, F.lit(0).cast("long")).otherwise(F.floor(F.col("total_loc") * floor / 100).cast("long") - F.col("hidden_loc")).alias("exposed_loc"))


def component_shares(modules: DataFrame) -> DataFrame:
    """(component, modules, loc, exposed, exposed_pct) per component."""
    shown = F.sum(F.when(F.col("in_cross_component") > 0, F.col("loc")).otherwise(0))
    return modules.groupBy("component").agg(F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("loc"), shown.alias("exposed")).withColumn("exposed_pct", F.coalesce(F.try_divide(F.col("exposed"), F.col("loc")) * 100, F.lit(0.0)))
