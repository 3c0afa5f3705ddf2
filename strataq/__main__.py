"""python -m strataq COMMAND: scans, profiles and gates from a shell."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from strataq.config import load_config, scan_settings
from strataq.operators.tools import tool_verdicts
from strataq.operators import agreement, changes, coverage, delta, profile, review
from strataq.operators.snapshots import movement
from strataq.plans import scan as runs
from strataq.session import local_session
from strataq.sinks import render
from strataq.sources import records, tree


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataq")
    top.add_argument("--cpus", type=int, default=8)
    sub = top.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="rules and profiles of a Go module")
    scan.add_argument("root")
    scan.add_argument("--format", choices="text csv json markdown metrics profile units modules snapshot".split(), default="text")
    for name in ("config", "acceptances", "components", "deviations", "baseline", "prefix", "rev", "taken", "out", "fail-on"):
        scan.add_argument(f"--{name}", default="")
    scan.add_argument("--units", action="append", default=[], help="an external unit set, once per language")
    dupes = sub.add_parser("declarations", help="declarations made twice")
    dupes.add_argument("--root", action="append", default=[])
    dupes.add_argument("--config", default="")
    dupes.add_argument("--json", action="store_true")
    dupes.add_argument("--strict", action="store_true")
    diff = sub.add_parser("delta", help="change between two inventories")
    diff.add_argument("before"), diff.add_argument("after")
    diff.add_argument("--floor", type=float, default=0.0)
    diff.add_argument("--format", choices="text markdown json".split(), default="text")
    cov = sub.add_parser("coverage", help="coverage against a floor")
    cov.add_argument("profile"), cov.add_argument("root"), cov.add_argument("floor")
    cov.add_argument("--worst", type=int, default=10)
    cov.add_argument("--markdown", action="store_true")
    agree = sub.add_parser("agreement", help="two tools' inventories of the same functions")
    agree.add_argument("ours"), agree.add_argument("theirs")
    agree.add_argument("--language", default="Go")
    ratchet = sub.add_parser("changes", help="changed files without those that changed in comments only")
    ratchet.add_argument("repo"), ratchet.add_argument("base")
    ratchet.add_argument("--patch", action="store_true", help="print the patch of the files that stay")
    gate = sub.add_parser("tools", help="installed tools against the versions a project wants")
    gate.add_argument("wanted", help="JSON: tool to command and wanted version")
    plan = sub.add_parser("publish", help="what publishing the findings would do to a tracker's issues; nothing is sent")
    plan.add_argument("root"), plan.add_argument("issues", help="the tracker's JSON export")
    plan.add_argument("--config", default="")
    return top


def _table(rows, out: str | None, *order: str) -> str:
    """A table written as a folder of CSV parts, or every row of it as text."""
    if out:
        render.write_csv(rows, out)
        return ""
    return "".join(render.table_lines(rows.orderBy(*order)))


def _scan(spark, a) -> tuple[str, int]:
    s = runs.scan_module(spark, a.root, load_config(a.config or None), a.prefix)
    parts = a.components and records.components(spark, a.components)[1] or None
    if a.format in ("text", "csv", "json", "markdown", "metrics"):
        reviewed = records.acceptances(spark, a.acceptances) if a.acceptances else None
        found, stale = runs.findings(s, reviewed)
        still = found.where("NOT accepted").drop("accepted")
        if a.format == "metrics":
            deps = runs.coupling.file_dependencies(s.parsed, runs.coupling.met_references(s.parsed), s.config.span_granularity)
            rows = render.metrics(runs.fact(s.parsed, "units"), deps)
            text = _table(rows, a.out, "file", "line")
        elif a.format == "text":
            summary = render.accepted_text(review.accepted_summary(found, reviewed, ["rule", "file", "element"])) if reviewed is not None and not a.prefix else ""
            text = render.findings_text(found) + summary
        elif a.format == "markdown":
            issues = render.issues(still)
            text = render.issues_markdown(issues)
            if a.out:
                render.write_issue_files(issues, a.out)
        elif a.out:
            render.write_findings(still, a.out, a.format)
            text = ""
        else:
            text = (render.findings_csv if a.format == "csv" else render.findings_json)(still)
        gone = render.stale_text(stale) if stale is not None else ""
        code = render.fail_on(still, a.fail_on) if a.fail_on else render.PASSED
        return text + (gone + "\n" if gone else ""), render.FAILURE if gone else code
    sets = records.unit_sets(spark, a.units) if a.units else None
    if a.format == "units":
        rows = render.units_audit(runs.all_units(s, sets))
        return _table(rows, a.out, "language", "file", "line"), render.PASSED
    got = runs.risk_profile(s, sets, records.deviations(spark, a.deviations) if a.deviations else None, parts)
    if a.format == "modules":
        rows = render.modules_audit(got["modules"])
        return _table(rows, a.out, "rel"), render.PASSED
    snap = runs.snapshot(got, s.parsed.count())
    if a.format == "snapshot":
        return render.snapshot_json(snap, a.taken, a.rev), render.PASSED
    base = records.baseline(spark, a.baseline or None)
    moves = None if base is None else movement(snap, base, "language")
    text = render.profile_markdown(got["totals"], got["tails"], "language", moves, got["volume"], render.module_markdown(got, "language")) + render.standing_markdown(got["standing"], got["distances"], "language")
    return text, render.FAILURE if profile.unmeasured(got["totals"], "language").count() else render.PASSED


def run(argv: list[str], spark=None) -> tuple[str, int]:
    """What a command prints and returns."""
    a = _arguments().parse_args(argv)
    spark = spark or local_session(a.cpus)
    if a.command == "scan":
        return _scan(spark, a)
    if a.command == "declarations":
        settings = scan_settings({"roots": a.root}, a.config or "declarations.json", bool(a.config))
        ranked, n = runs.declaration_scan(spark, settings["roots"], settings["skip_paths"], settings["auto_import_paths"])
        return render.declarations_report(ranked, n, a.json), render.GATE if a.strict and not ranked.isEmpty() else render.PASSED
    if a.command == "delta":
        before, after = (records.unit_inventory(spark, p) for p in (a.before, a.after))
        if before.isEmpty() and after.isEmpty():
            raise ValueError("both inventories are empty")
        return render.delta_report(delta.delta_scores(delta.delta_files(before, after)), "language", a.floor, a.format)
    if a.command == "coverage":
        with open(a.floor, encoding="utf-8") as f:
            floor = records.coverage_floor(f.read())
        with open(f"{a.root}/go.mod", encoding="utf-8") as f:
            module = tree.module_path(f.read())
        sources = tree.read_tree(spark, a.root, "*.go").select(F.concat(F.lit(module + "/"), "rel").alias("file"), tree.is_generated(F.col("body")).alias("generated"))
        files = coverage.classified(coverage.covered_files(records.coverage_blocks(spark, a.profile)), sources)
        return render.coverage_report(coverage.packages(files), coverage.verdict(files, floor), floor, a.worst, a.markdown)
    if a.command == "agreement":
        pairs = agreement.matched(records.inventory_by_place(spark, a.ours, a.language), records.second_tool(spark, a.theirs), ["file", "line"], ["loc", "mccabe", "params"], "ordinal")
        return render.agreement_text(agreement.agreement_stats(pairs), agreement.worst_divergence(pairs, 10)), render.PASSED
    if a.command == "tools":
        with open(a.wanted, encoding="utf-8") as f:
            wanted = json.load(f)
        rows = [(tool, records.tool_version(*w["command"]), w.get("wanted")) for tool, w in sorted(wanted.items())]
        got = tool_verdicts(spark.createDataFrame(rows, "tool string, output string, wanted string")).orderBy("tool").collect()
        return "".join(f"{r['tool']}: {r['verdict']}, {r['version'] or 'no version'} (wanted {r['wanted']})\n" for r in got), render.PASSED if all(r["verdict"] == "ok" for r in got) else render.FAILURE
    if a.command == "publish":
        found, _ = runs.findings(runs.scan_module(spark, a.root, load_config(a.config or None)), None)
        mine = [(i["marker"], i["title"], i["body"]) for i in render.issues(found.drop("accepted"))]
        actions = review.issue_actions(spark.createDataFrame(mine, "marker string, title string, body string"), records.issues(spark, a.issues))
        return "".join(f"{r['action']} {'#' + str(r['number']) + ' ' if r['number'] is not None else ''}{r['title']}\n" for r in actions.orderBy("title").collect()), render.PASSED
    changed = records.git_changes(spark, a.repo, a.base)
    paths = [r["path"] for r in changed.where("status = 'M'").collect()]
    work = tree.read_tree(spark, a.repo, "*.go").select(F.col("rel").alias("path"), "body")
    kept = changes.partition_changes(changed, records.git_blobs(spark, a.repo, a.base, paths), work)
    if a.patch:
        return records.git_patch(a.repo, a.base, [r["path"] for r in kept.where("NOT exempt").orderBy("path").collect()]), render.PASSED
    return "".join(f"{r['status']} {r['path']}\n" for r in kept.where("NOT exempt").orderBy("path").collect()) + render.exemptions_text(kept), render.PASSED


if __name__ == "__main__":
    try:
        text, code = run(sys.argv[1:])
    except (ValueError, OSError) as err:
        text, code = f"{err}\n", render.FAILURE
    sys.stdout.write(text)
    sys.exit(code)
