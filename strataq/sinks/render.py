"""Text, CSV, JSON and Markdown of results that a person or a gate reads.

Tables of any size are written by Spark (write_csv, write_json); what is
rendered on the driver is counts, profiles and tops, whose size a rule, a
language or a limit bounds.
"""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from strataq import dims
from strataq.operators import profile, review

ISSUE_ROWS, ISSUE_PACKAGES = 25, 25
MARKER = "<!-- {} -->"

#: What a command returns: all well, a gate that does not hold, a failure.
PASSED, GATE, FAILURE = 0, 1, 2


def thousands(n: int) -> str:
    return f"{n:,}"


def plural(n: int, word: str) -> str:
    return f"{thousands(n)} {word}{'' if n == 1 else 's'}"


def escape_pipes(text: str) -> str:
    return text.replace("|", "\\|")


def _csv(header: list[str], rows: list) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def _table(header: list[str], rows: list[list[str]]) -> str:
    return "\n".join(["| " + " | ".join(header) + " |", "|" + "---|" * len(header), *["| " + " | ".join(escape_pipes(str(c)) for c in r) + " |" for r in rows]]) + "\n"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# --- findings


def findings_text(findings: DataFrame) -> str:
    """Counts per rule: open, high, very high and accepted, then the accepted ones' total. Takes findings with or without accepted."""
    rows = findings if "accepted" in findings.columns else findings.withColumn("accepted", F.lit(False))
    per = {r["rule"]: r for r in rows.groupBy("rule").agg(F.count_if(~F.col("accepted")).alias("open"), F.count_if(~F.col("accepted") & (F.col("severity") == "high risk")).alias("high"), F.count_if(~F.col("accepted") & (F.col("severity") == "very high risk")).alias("very"), F.count_if("accepted").alias("acc")).collect()}
    lines = [f"{'RULE':<30}{'OPEN':>8}{'HIGH':>8}{'VERY HIGH':>12}{'ACCEPTED':>10}"]
    for rule in dims.RULES:
        r = per.get(rule)
        n = (r["open"], r["high"], r["very"], r["acc"]) if r else (0, 0, 0, 0)
        lines.append(f"{rule:<30}{n[0]:>8}{n[1]:>8}{n[2]:>12}{accepted_cell(n[3]):>10}")
    return "\n".join(lines) + "\n"


def accepted_cell(n: int) -> str:
    return str(n) if n else "-"


def accepted_text(summary: DataFrame) -> str:
    """Per rule how many findings were accepted, why, and where that is recorded."""
    rows = {r["rule"]: r for r in summary.collect()}
    if not rows:
        return ""
    out = [f"\nAccepted ({sum(r['accepted'] for r in rows.values())} findings reviewed and judged correct as written):"]
    for rule in [r for r in dims.RULES if r in rows]:
        out += [f"  {rule}: {rows[rule]['accepted']}", *[f"    - {x}" for x in rows[rule]["reasons"]], *[f"    see {x}" for x in rows[rule]["refs"]]]
    return "\n".join(out) + "\n"


def stale_text(stale: DataFrame) -> str:
    """What a stale-acceptance gate says; empty when it holds. Raised after the report is written."""
    rows = stale.orderBy("rule", "file", "element").collect()  # no more than were recorded
    if not rows:
        return ""
    return f"{len(rows)} acceptance(s) no longer match the code:" + "".join(f"\n  {r['rule']} {r['file']} {r['element']}: claims {r['count']}, matched {r['matched']}" for r in rows)


_CSV_ORDER = ["file", "line", "element"]


def findings_csv_lines(findings: DataFrame) -> Iterator[str]:
    """One section per rule, also for rules without findings; ids count from 1 in each. Rows come one by one."""
    last = None
    for r in review.sectioned(findings, [F.col("value").desc(), *_CSV_ORDER]).orderBy("rank", "id").toLocalIterator():
        if r["rule"] != last:
            yield ("\n" if last else "") + r["rule"] + "\n" + _csv(["id", "element", "description", "filename", "line", "severity"], []).rstrip("\n") + "\n"
            last = r["rule"]
        if r["id"] is not None:
            yield _csv([r["id"], r["element"], r["description"], r["file"], r["line"], r["severity"]], [])


def findings_csv(findings: DataFrame) -> str:
    return "".join(findings_csv_lines(findings))


def findings_json_lines(findings: DataFrame) -> Iterator[str]:
    """A list in report order; no findings is an empty list. A value of 0 is left out. Rows come one by one."""
    opening = "["
    for r in review.ordered(findings).toLocalIterator():
        row = {"rule": r["rule"], "element": r["element"], "description": r["description"], "filename": r["file"], "line": r["line"], "severity": r["severity"]}
        text = json.dumps(row | ({"value": r["value"]} if r["value"] else {}), indent=2, ensure_ascii=False)
        yield opening + "\n  " + text.replace("\n", "\n  ")
        opening = ","
    yield "[]\n" if opening == "[" else "\n]\n"


def findings_json(findings: DataFrame) -> str:
    return "".join(findings_json_lines(findings))


def write_findings(findings: DataFrame, path: str, kind: str) -> None:
    """All findings as a folder of CSV or JSON parts in report order, written by the executors: rule, id within the rule and the rest."""
    rows = review.sectioned(findings, [F.col("value").desc(), *_CSV_ORDER]).where("id IS NOT NULL").orderBy("rank", "id").select("rule", "id", "element", "description", F.col("file").alias("filename"), "line", "severity", "value")
    (rows.write.mode("overwrite").option("header", True).csv(path) if kind == "csv" else rows.write.mode("overwrite").json(path))


def table_lines(rows: DataFrame) -> Iterator[str]:
    """Every row of a table as a line of CSV, one by one."""
    yield _csv(rows.columns, [])
    for r in rows.toLocalIterator():
        yield _csv(list(r), [])


def metrics(units: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Threshold-free rows of functions and files in one table, for write_csv."""
    none = F.lit(None).cast("int")
    funcs = units.select(F.lit("function").alias("kind"), "module", F.col("rel").alias("file"), "element", "line", "tokens", "params", "complexity", none.alias("volume"), none.alias("span"))
    files = dependencies.select(F.lit("file").alias("kind"), "module", F.col("rel").alias("file"), F.element_at(F.split("rel", "/"), -1).alias("element"), "line", none.alias("tokens"), none.alias("params"), none.alias("complexity"), F.col("volume").cast("int").alias("volume"), F.col("span").cast("int").alias("span"))
    return funcs.unionByName(files)


def issues(findings: DataFrame) -> list[dict[str, Any]]:
    """One issue per rule with findings: title, labels, marker, and a body with the worst rows and the packages they are in."""
    top = {}
    for r in review.top(findings, ["rule"], [F.col("value").desc(), "file", "line", "element"], ISSUE_ROWS).orderBy("place").collect():
        top.setdefault(r["rule"], []).append(r)
    packages: dict[str, list[Row]] = {}
    where = F.when(F.col("file").contains("/"), F.regexp_replace("file", r"/[^/]*$", "")).otherwise(".")
    per = findings.groupBy("rule", where.alias("package")).agg(F.count(F.lit(1)).alias("n"))
    for r in review.top(per, ["rule"], [F.col("n").desc(), "package"], ISSUE_PACKAGES).orderBy("place").collect():
        packages.setdefault(r["rule"], []).append(r)
    totals = {r["rule"]: r["findings"] for r in review.counts(findings).collect()}
    out = []
    for rule in [r for r in dims.RULES if r in top]:
        marker, rows = MARKER.format(rule), top[rule]
        body = [marker, "", plural(totals[rule], "finding") + ".", "", _table(["package", "findings"], [[p["package"], p["n"]] for p in packages[rule]])]
        body.append(_table(["element", "description", "place"], [[r["element"], r["description"], f"{r['file']}:{r['line']}"] for r in rows]))
        if rows[0]["more"]:
            body.append(f"and {thousands(rows[0]['more'])} more")
        out.append({"rule": rule, "marker": marker, "title": f"{rule.replace('_', ' ').capitalize()}: {plural(totals[rule], 'finding')}", "labels": ["quality", "review" if rule in dims.REVIEW_RULES else "fix"], "body": "\n".join(body)})
    return out


def issues_markdown(found: list[dict[str, Any]]) -> str:
    return "\n".join(f"# {i['title']}\n\n{i['body']}\n" for i in found)


def write_issue_files(found: list[dict[str, Any]], directory: str) -> list[str]:
    """One file per issue with front matter, NN-rule.md."""
    os.makedirs(directory, exist_ok=True)
    paths = []
    for n, i in enumerate(found, 1):
        path = os.path.join(directory, f"{n:02d}-{i['rule'].lower().replace('_', '-')}.md")
        with open(path, "w", encoding="utf-8") as f:
            f.write(f"---\ntitle: {json.dumps(i['title'])}\nlabels: {json.dumps(i['labels'])}\n---\n\n{i['body']}\n")
        paths.append(path)
    return paths


# --- profiles


def units_audit(units: DataFrame) -> DataFrame:
    """Units with the label of each property's category, for write_csv."""
    return units.select("*", *[profile.category_of(F.col(c), bands).alias(f"{p}_category") for p, (c, bands, _) in dims.UNIT_PROPERTIES.items()])


def modules_audit(modules: DataFrame) -> DataFrame:
    """Modules with hidden and the category of their incoming modules, whichever way coupling counts elsewhere."""
    return modules.select("*", (F.col("in_cross_component") == 0).alias("hidden"), profile.category_of(F.col("in_modules"), dims.MODULE_PROPERTIES["module_coupling"][1]).alias("module_coupling_category"))


def module_markdown(parts: dict[str, DataFrame], group: str) -> dict[str, list[str]]:
    """Per language the sections on modules, components and duplication that were measured; parts from risk_profile()."""
    out: dict[str, list[str]] = {}

    def add(name: str, section: str) -> None:
        out.setdefault(name, []).append(section)

    def verdict(r: Row, unit: str, over: str) -> str:
        return "" if r[group] == profile.COMBINED else "at cap" if "at_cap" in r and r["at_cap"] else "pass" if r["pass"] else f"over by {thousands(r[over])} {unit}"

    tables: dict[str, list[list]] = {}
    for r in parts["coupling"].orderBy(group, F.regexp_extract("tail", r"\d+", 0).cast("int")).collect():
        tables.setdefault(r[group], []).append([r["tail"], thousands(r["elements"]), thousands(r["loc"]), f"{r['pct']:.1f}", f"{r['cap_pct']:.1f}", verdict(r, "lines", "excess_loc")])
    for name, rows in tables.items():
        add(name, "### Modules\n\n" + _table(["incoming", "modules", "lines", "%", "cap", "verdict"], rows))
    shares: dict[str, list[list]] = {}
    for r in parts["component_shares"].orderBy(group, F.col("exposed_pct").desc(), "component").collect() if "component_shares" in parts else []:
        shares.setdefault(r[group], []).append([r["component"], thousands(r["modules"]), thousands(r["loc"]), thousands(r["exposed"]), f"{r['exposed_pct']:.1f}"])
    for r in parts["independence"].collect() if "independence" in parts else []:
        says = f"{r['pct']:.1f} % of {thousands(r['total_loc'])} lines hidden in their component, floor {r['floor_pct']:.1f}: " + ("pass" if r["pass"] else f"{thousands(r['exposed_loc'])} lines too many in the open")
        add(r[group], "### Independence\n\n" + says + "\n\n" + _table(["component", "modules", "lines", "exposed", "%"], shares.get(r[group], [])))
    bad: dict[str, list[list]] = {}
    for r in parts["violations"].orderBy(group, F.col("weight").desc(), "from", "to").collect() if "violations" in parts else []:
        bad.setdefault(r[group], []).append([r["kind"], r["from"], r["to"], r["weight"], r["detail"]])
    for r in parts["entanglement"].collect() if "entanglement" in parts else []:
        says = f"{plural(r['lines'], 'line')} between {r['connected']} components, density {r['density']:.2f}, violation degree {r['violation_degree']:.3f}"
        add(r[group], "### Entanglement\n\n" + says + "\n" + ("\n" + _table(["kind", "from", "to", "weight", "why"], bad[r[group]]) if r[group] in bad else ""))
    for r in parts["duplication"].collect() if parts.get("duplication") is not None else []:
        add(r[group], f"### Duplication\n\n{thousands(r['redundant_loc'])} of {thousands(r['total_loc'])} lines ({r['pct']:.1f} %): {verdict(r, 'lines', 'excess_loc') or 'no verdict over all languages'}\n")
    return out


def profile_markdown(totals: DataFrame, tails: DataFrame, group: str, movement: DataFrame | None = None, volume: DataFrame | None = None, sections: dict[str, list[str]] | None = None) -> str:
    """Per language: size, each tail's share against its cap with the deviation recorded for it, and its further sections. tails from with_deviations."""
    out = ["# Risk-profile distribution\n"]
    if movement is not None:
        out.append(movement_markdown(movement, group))
    rows: dict[str, list[Row]] = {}
    for r in tails.orderBy(group, "property", F.regexp_extract("tail", r"\d+", 0).cast("int")).collect():
        rows.setdefault(r[group], []).append(r)
    for t in sorted(totals.collect(), key=lambda r: (r[group] == profile.COMBINED, r[group])):
        out.append(f"## {t[group]}\n\n{plural(t['units'], 'unit')}, {thousands(t['unit_loc'])} lines in units, {t['non_unit_pct']:.1f} % outside.\n")
        if not t["measured"]:
            out.append("Not measured.\n")
            continue
        table, notes = [], []
        for r in rows.get(t[group], []):
            verdict = "" if t[group] == profile.COMBINED else ("at cap" if r["at_cap"] else "pass" if r["pass"] else f"over by {thousands(r['excess_loc'])} lines")
            table.append([r["property"], r["tail"], thousands(r["elements"]), thousands(r["loc"]), f"{r['pct']:.1f}", f"{r['cap_pct']:.1f}", verdict])
            if r["decided"]:
                notes.append(f"{r['property']} {r['tail']}: {r['summary']} (decided {r['decided']}{', ' + r['ref'] if r['ref'] else ''})")
        out += [_table(["property", "tail", "units", "lines", "%", "cap", "verdict"], table), *[f"- {n}" for n in notes]]
        if t[group] == profile.COMBINED:
            out.append("No verdict: caps are set for one language at a time.\n")
        out += (sections or {}).get(t[group], [])
    if volume is not None:
        out.append("## Volume\n\n" + _table(["language", "lines", "years"], [[v[group], thousands(v["loc"]), "not rated" if v["years"] is None else f"{v['years']:.1f}"] for v in volume.orderBy(F.col("loc").desc(), group).collect()]))
    return "\n".join(out)


def number_text(v: float) -> str:
    """The shortest text of a figure."""
    return repr(float(v)).removesuffix(".0")


def delta_text(v: float) -> str:
    """A difference with its sign, without the noise of floating point."""
    v = round(v, 3)
    return ("+" if v > 0 else "") + number_text(v)


def movement_markdown(moves: DataFrame, group: str) -> str:
    rows = moves.orderBy(group, "measure").collect()
    if not rows:
        return "Nothing moved since the baseline.\n"
    cells = [[r[group], r["measure"], "" if r["then"] is None else number_text(r["then"]), "" if r["now"] is None else number_text(r["now"]), delta_text(r["now"] - r["then"]) if r["kind"] == "moved" else r["kind"]] for r in rows]
    return _table(["language", "measure", "then", "now", "change"], cells)


def standing_markdown(standing: DataFrame, distances: DataFrame, group: str) -> str:
    """Per language how many caps hold, and how far the others are."""
    out = [_table(["language", "within", "over", "deviated", "all within"], [[r[group], r["within"], r["over"], r["deviated"], "yes" if r["eligible"] else "no"] for r in standing.orderBy(group).collect()])]
    out.append(_table(["language", "property", "lines over"], [[r[group], r["property"], thousands(r["excess_loc"])] for r in distances.orderBy(F.col("excess_loc").desc(), group, "property").limit(100).collect()]))
    return "\n".join(out)


def snapshot_json(rows: DataFrame, taken: str, rev: str) -> str:
    """A snapshot document from (language, files_scanned, unit_loc, measures, entanglement); signs in keys stay legible."""
    languages = []
    for r in rows.orderBy("language").collect():
        entry = {"language": r["language"], "files_scanned": r["files_scanned"], "unit_loc": r["unit_loc"], "measures": dict(sorted((r["measures"] or {}).items()))}
        languages.append(entry | ({"entanglement": r["entanglement"]} if r["entanglement"] else {}))
    return json.dumps({"taken": taken, "rev": rev, "languages": languages}, indent=2, ensure_ascii=False) + "\n"


# --- gates


def delta_report(scores: DataFrame, language: str, floor: float, form: str = "text") -> tuple[str, int]:
    """The change score per property as text, markdown or json, and what the gate returns. No churn is no score, and passes."""
    rows = scores.orderBy(language, "property").collect()
    bad = [r for r in rows if r["score"] is not None and r["score"] < floor]
    if form == "json":
        text = json.dumps([{"language": r[language], "property": r["property"], "good": r["good"], "bad": r["bad"], "score": r["score"]} for r in rows], indent=2) + "\n"
    else:
        cells = [[r[language], r["property"], r["good"], r["bad"], "no change" if r["score"] is None else f"{r['score']:.2f}"] for r in rows]
        text = _table(["language", "property", "good", "bad", "score"], cells) if form == "markdown" else "".join(f"{a}  {b:<18} good {c} bad {e} score {s}\n" for a, b, c, e, s in cells)
        text += f"{plural(len(bad), 'property')} below {floor:.2f}\n" if bad else f"every measured property at {floor:.2f} or above\n"
    return text, GATE if bad else PASSED


def coverage_report(packages: DataFrame, verdict: DataFrame, floor: float, worst: int = 10, markdown: bool = False) -> tuple[str, int]:
    """The verdict line and the packages with the most statements uncovered."""
    v = verdict.first()
    line = f"{v['pct']:.1f} % of {thousands(v['statements'])} statements covered, floor {floor:.1f}; {thousands(v['generated_statements'])} generated left out"
    line += f"; {plural(v['shortfall'], 'statement')} short" if v["breached"] else f"; room for {plural(v['headroom'], 'statement')}" + (f"; the floor can rise to {v['raise_to']:.1f}" if v["raise_to"] is not None else "")
    rows = [[r["package"], r["uncovered"], f"{r['pct']:.1f}"] for r in packages.orderBy(F.col("uncovered").desc(), "package").limit(worst).collect()]
    body = _table(["package", "uncovered", "%"], rows) if markdown else "".join(f"{u:>8}  {p:>5}  {n}\n" for n, u, p in rows)
    return f"{line}\n{body}", GATE if v["breached"] else PASSED


def append_summary(path: str, text: str) -> None:
    """Adds a report to a job's summary file."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(text)


def agreement_text(stats: DataFrame, worst: DataFrame) -> str:
    out = []
    for r in stats.orderBy("measure").collect():
        out.append(f"{r['measure']}: {thousands(r['matched'])} matched, {thousands(r['equal'])} equal, median ratio {'-' if r['median_ratio'] is None else format(r['median_ratio'], '.3f')}, {thousands(r['outside'])} outside")
    out += [f"  {r['measure']} {number_text(r['ours'])} against {number_text(r['theirs'])}: {' '.join(str(r[c]) for c in worst.columns if c not in ('measure', 'ours', 'theirs', 'ratio', 'distance'))}" for r in worst.collect()]
    return "\n".join(out) + "\n"


def exemptions_text(partitioned: DataFrame) -> str:
    """How many changed files are exempt, and every one of them."""
    rows = [r["path"] for r in partitioned.where("exempt").orderBy("path").toLocalIterator()]
    return f"{plural(len(rows), 'file')} changed in comments only\n" + "".join(f"  {p}\n" for p in rows)


def declarations_report(ranked: DataFrame, scanned: int, as_json: bool = False, limit: int | None = None) -> str:
    """The ranked declaration findings as JSON or text, all or the first `limit`; then the rest is counted."""
    from strataq.operators.declarations import in_rank

    kept = in_rank(ranked)
    rows = list((kept if limit is None else kept.limit(limit)).toLocalIterator())
    more = ranked.count() - len(rows) if limit is not None else 0
    if as_json:
        out = {"scanned": scanned, "findings": [r.asDict(recursive=True) for r in rows]} | ({"more": more} if more else {})
        return json.dumps(out, indent=2, ensure_ascii=False) + "\n"
    text = "".join(f"{r['level']:<7}{r['score']:>3}  {r['check']}: {r['title']}\n" + "".join(f"           {w}\n" for w in r["why"]) + "".join(f"           {s['file']} ({s['name']})\n" for s in r["sites"]) for r in rows)
    return text + (f"and {thousands(more)} more\n" if more else "")


def fail_on(findings: DataFrame, severity: str) -> int:
    """What a scan returns that must not find anything of a severity; findings that block are a failure, not a gate."""
    return FAILURE if findings.where(F.col("severity") == severity).limit(1).count() else PASSED
