"""Whole runs over a source tree: what a command computes, as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.config import Config
from strataq.functions.text import qualify
from strataq.operators import coupling, declarations, duplication, graph, profile, review, snapshots
from strataq.operators.facts import fact, parse_go
from strataq.operators.rules import run_rules
from strataq.sources import records, tree


@dataclass
class Scan:
    """A parsed module and its settings."""

    parsed: DataFrame
    config: Config
    prefix: str = ""


def scan_module(spark: SparkSession, root: str, config: Config | None = None, prefix: str = "") -> Scan:
    """The Go module at root; a file that does not parse fails the scan."""
    cfg = config or Config()
    with open(os.path.join(root, "go.mod"), encoding="utf-8") as f:
        module = tree.module_path(f.read())
    files = tree.read_tree(spark, root, "*.go").withColumn("module", F.lit(module)).withColumn("dir", tree.directory(F.col("rel")))
    return Scan(parse_go(tree.go_sources(files, cfg.exclude_dirs, cfg.include_tests, cfg.skip_generated_files), strict=True), cfg, prefix)


def findings(scan: Scan, acceptances: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(findings with accepted, stale acceptances). Reviews name files without the prefix."""
    found = run_rules(scan.parsed, scan.config)
    stale = None
    if acceptances is not None:
        key = ["rule", "file", "element"]
        stale = review.stale_acceptances(found, acceptances, key)
        # in report order: the largest value first
        found = review.apply_acceptances(found.withColumn("_rank", -F.col("value")), acceptances, key, ["_rank", "line", "description"]).drop("_rank")
    else:
        found = found.withColumn("accepted", F.lit(False))
    return found.withColumn("file", qualify(scan.prefix, F.col("file"))), stale


def modules(scan: Scan, components: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files with loc, fan-in and component; dependencies between them). A file that no component owns is an error."""
    files = scan.parsed.where("error IS NULL").select("module", "rel", F.col("loc").cast("int").alias("loc"))
    deps = coupling.module_dependencies(coupling.resolved_references(scan.parsed), files)
    if components is not None:
        files = coupling.owners(files, "rel", components)
        lost = [r["rel"] for r in files.where("component IS NULL").select("rel").orderBy("rel").limit(10).collect()]
        if lost:
            raise ValueError(f"files that belong to no component, starting with {lost}")
        names = files.select("rel", "component")
        deps = deps.join(names.select(F.col("rel").alias("source"), F.col("component").alias("source_component")), "source").join(names.select(F.col("rel").alias("target"), F.col("component").alias("target_component")), "target")
        fan = coupling.fan_in(deps, "source", "target", "refs", "source_component", "target_component")
    else:
        files = files.withColumn("component", F.lit(None).cast("string"))
        fan = coupling.fan_in(deps, "source", "target", "refs").withColumn("in_cross_component", F.lit(0).cast("long"))
    return coupling.measured_modules(files, "rel", fan, "target"), deps


def go_units(scan: Scan) -> DataFrame:
    return fact(scan.parsed, "units").where("has_body").select(F.lit("Go").alias("language"), "element", qualify(scan.prefix, F.col("rel")).alias("file"), "line", "loc", "mccabe", "params")


def all_units(scan: Scan, sets: DataFrame | None = None) -> DataFrame:
    """Units of the module and of external sets, in one relation."""
    own = go_units(scan)
    return own if sets is None else own.unionByName(sets.select("language", F.inline("units")))


def all_modules(own: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(language, file, loc, in_modules, in_refs, component, in_cross_component): the module's own files and those of external sets."""
    columns = ["language", "file", "loc", "in_modules", "in_refs", "component", "in_cross_component"]
    rows = own.select(F.lit("Go").alias("language"), F.col("rel").alias("file"), "loc", *[F.col(c).cast("long").alias(c) for c in ("in_modules", "in_refs")], "component", F.col("in_cross_component").cast("long").alias("in_cross_component"))
    if sets is None:
        return rows
    outer = sets.select("language", F.inline("modules"))
    return rows.unionByName(outer.select(*[F.col(c).cast("long").alias(c) if c.startswith("in_") else F.col(c) for c in columns]))


def claims_of(sets: DataFrame | None, decided: bool) -> dict[str, dict]:
    """Per language what it claims to measure and whether its components are decided; one row a language, read to the driver."""
    out = {"Go": {"metrics": set(profile.dims.MODULE_METRICS), "decided": decided}}
    if sets is not None:
        for r in sets.select("language", "module_metrics", "components_decided").collect():
            out[r["language"]] = {"metrics": set(r["module_metrics"] or []), "decided": bool(r["components_decided"])}
    return out


def _each(rows: DataFrame, languages: list[str], combined: bool, measure: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """measure() of each language's rows, and of all of them, labelled; None without a language."""
    parts = [measure(rows.where(F.col("language") == k)).withColumn("language", F.lit(k)) for k in languages]
    if combined:
        parts.append(measure(rows).withColumn("language", F.lit(profile.COMBINED)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def risk_profile(scan: Scan, sets: DataFrame | None = None, deviations: DataFrame | None = None, components: DataFrame | None = None) -> dict[str, DataFrame]:
    """totals, tails (with deviations), standing, distances, volume, modules, coupling tails, duplication and, with components, independence and entanglement.

    What a language does not claim to measure is absent for it, and the roll-up
    holds only what every language claims.
    """
    units = all_units(scan, sets)
    lines = scan.parsed.where("error IS NULL").select("module", "rel", "loc")
    outside = profile.non_unit_lines(lines, fact(scan.parsed, "units")).select(F.lit("Go").alias("language"), F.col("non_unit_loc").cast("long"))
    if sets is not None:
        outside = outside.unionByName(sets.select("language", F.col("non_unit_loc").cast("long").alias("non_unit_loc")))
    totals = profile.language_totals(units, "language", outside)
    none = scan.parsed.sparkSession.createDataFrame([], records.DEVIATIONS)
    tails = profile.with_deviations(profile.tail_shares(units, "language"), "language", none if deviations is None else deviations)
    mods, deps = modules(scan, components)
    every = all_modules(mods, sets)
    claims = claims_of(sets, components is not None)
    claiming = lambda metric: [k for k, c in claims.items() if metric in c["metrics"]]
    by_all = lambda metric: len(claiming(metric)) == len(claims)
    incoming = F.col("in_refs") if scan.config.module_coupling_counts == "references" else F.col("in_modules")
    coupled = profile.tail_shares(every.where(F.col("language").isin(claiming("coupling"))).withColumn("incoming", incoming), "language", {"module_coupling": profile.dims.MODULE_PROPERTIES["module_coupling"]})
    own_lines = fact(scan.parsed, "lines")
    all_lines = own_lines.select(F.lit("Go").alias("language"), F.col("rel").alias("file"), "i", "line_text")
    if sets is not None:
        all_lines = all_lines.unionByName(sets.select("language", F.inline("modules")).select("language", "file", F.posexplode("lines").alias("i", "line_text")))
    out = {
        "totals": totals,
        "tails": tails,
        "standing": profile.standing(tails, "language"),
        "distances": profile.distances(tails, "language"),
        "volume": profile.volume(totals, "language"),
        "modules": mods,
        "coupling": coupled if by_all("coupling") else coupled.where(F.col("language") != profile.COMBINED),
        "duplication": _each(all_lines, claiming("duplication"), by_all("duplication"), lambda rows: duplication.duplication(rows, ["language", "file"])),
        "module_duplication": duplication.module_duplication(own_lines, ["module", "rel"]),
    }
    decided = [k for k in claiming("coupling") if claims[k]["decided"]]
    if decided:
        edges = [] if components is None else [coupling.component_edges(deps, "source_component", "target_component", "source", "target").withColumn("language", F.lit("Go"))]
        if sets is not None:
            edges.append(sets.where(F.col("language").isin(decided)).select("language", F.inline("component_edges")).select(F.col("from"), F.col("to"), F.col("weight").cast("long").alias("weight"), "language"))
        lines_between = reduce(DataFrame.unionByName, edges)
        bounded = every.where(F.col("language").isin(decided))
        out |= {
            "independence": _each(bounded, decided, False, lambda rows: coupling.independence(rows, profile.dims.INDEPENDENCE_FLOOR)),
            "component_shares": _each(bounded, decided, False, coupling.component_shares),
            "entanglement": graph.entanglement(lines_between, "language"),
            "violations": graph.violations(lines_between, "language"),
        }
    return out


def snapshot(parts: dict[str, DataFrame], files_scanned: int) -> DataFrame:
    """(language, files_scanned, unit_loc, measures, entanglement) of measured languages."""
    measured = parts["totals"].where(F.col("measured") & (F.col("language") != profile.COMBINED)).select("language", F.when(F.col("language") == "Go", files_scanned).alias("files_scanned"), "unit_loc")
    measures = snapshots.tail_measures(parts["tails"].unionByName(parts["coupling"].where(F.col("language") != profile.COMBINED), allowMissingColumns=True), "language")
    rows = measured.join(measures, "language")
    if "entanglement" in parts:
        return rows.join(snapshots.entanglement_measures(parts["entanglement"], "language"), "language", "left")
    return rows.withColumn("entanglement", F.lit(None).cast("map<string,double>"))


def declaration_scan(spark: SparkSession, roots: list[str], skip_paths: list[str], auto_import: list[str]) -> tuple[DataFrame, int]:
    """(ranked findings, files scanned) of the roots; a root that is missing is passed over."""
    files = None
    for root in roots:
        one = tree.read_tree(spark, root).withColumn("rel", qualify("" if root in (".", "") else root.rstrip("/"), F.col("rel")))
        files = one if files is None else files.unionByName(one)
    sources = declarations.script_facts(tree.script_sources(files, skip_paths).select("rel", "text"))
    ts = sources.where(~F.col("rel").endswith(".go"))
    ranked = declarations.ranked(
        declarations.duplicate_exports(ts), declarations.duplicate_values(ts), declarations.duplicate_unions(ts), declarations.union_subsets(ts), declarations.duplicate_shapes(ts), declarations.duplicate_helpers(declarations.go_helpers(sources)), auto_import
    )
    return ranked, sources.count()
