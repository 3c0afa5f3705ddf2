"""Records a scan is judged against: reviews, component maps, unit sets, inventories, coverage, changes."""

from __future__ import annotations

import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq import dims
from strataq.functions.text import normal_path

ACCEPTANCES = "rule string, file string, element string, count int, reviewed string, reason string, ref string"
COMPONENTS = "name string, paths array<string>, reason string"
DEVIATIONS = "language string, property string, tail string, decided string, measured string, ref string, summary string, reasoning array<string>, still_gated string"
UNIT = "element string, file string, line int, loc int, mccabe int, params int"
MODULE = "file string, loc int, in_modules int, in_refs int, component string, in_cross_component int, lines array<string>"
UNIT_SET = (
    f"language string, root string, non_unit_loc int, files_scanned int, units array<struct<{UNIT}>>, modules array<struct<{MODULE}>>, components_decided string, "
    "module_metrics array<string>, component_edges array<struct<from string, to string, weight int>>"
)
SNAPSHOT = "model string, version string, star_target int, taken string, rev string, languages array<struct<language string, files_scanned int, unit_loc int, measures map<string,double>, entanglement map<string,double>>>"


def _refuse(bad: DataFrame, what: str) -> None:
    first = bad.limit(3).collect()
    if first:
        raise ValueError(f"{what}: {[r.asDict() for r in first]}")


def _json(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    return spark.read.schema(f"{field} array<struct<{schema}>>").option("mode", "FAILFAST").json(path, multiLine=True).select(F.inline(field))


def acceptances(spark: SparkSession, path: str | None) -> DataFrame:
    """Reviewed findings. Each needs a rule, file, element, count of at least 1, reviewed and reason; a ref may be missing."""
    if not path:
        return spark.createDataFrame([], ACCEPTANCES)
    rows = _json(spark, path, ACCEPTANCES, "acceptances").withColumn("ordinal", F.monotonically_increasing_id())
    lacking = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("rule", "file", "element", "reviewed", "reason")]
    bad = F.coalesce(F.col("count"), F.lit(0)) < 1
    for c in lacking:
        bad = bad | c
    _refuse(rows.where(bad), "acceptances that lack something")
    return rows


def components(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(date decided, one row per component and path). Needs a date, components, and of each a unique name, a path and a reason."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    listed = raw.get("components") or []
    names = [c.get("name") for c in listed]
    if not raw.get("decided"):
        raise ValueError("a component map needs the date it was decided")
    if not listed or any(not c.get("name") or not c.get("paths") or not c.get("reason") for c in listed):
        raise ValueError("every component needs a name, a path and a reason")
    if len(set(names)) < len(names):
        raise ValueError("a component is declared twice")
    rows = [(c["name"], p.strip("/")) for c in listed for p in c["paths"] if p.strip("/")]
    return raw["decided"], spark.createDataFrame(rows, "component string, path string")


def deviations(spark: SparkSession, path: str | None) -> DataFrame:
    """Recorded deviations from a property of units; each (language, property, tail) once."""
    if not path:
        return spark.createDataFrame([], DEVIATIONS)
    rows = _json(spark, path, DEVIATIONS, "deviations")
    _refuse(rows.where(~F.col("property").isin(list(dims.UNIT_PROPERTIES))), "deviations of an unknown property")
    lacking = F.lit(False)
    for c in ("language", "tail", "decided", "measured", "summary"):
        lacking = lacking | (F.coalesce(F.col(c), F.lit("")) == "")
    _refuse(rows.where(lacking), "deviations that lack something")
    _refuse(rows.groupBy("language", "property", "tail").count().where("count > 1"), "deviations given twice")
    return rows


def unit_sets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """External measurements, one row per language, with their claims checked."""
    sets = spark.read.schema(UNIT_SET).option("mode", "FAILFAST").json(paths, multiLine=True)
    _refuse(sets.where(F.trim(F.coalesce("language", F.lit(""))) == "").select("root"), "unit sets without a language")
    claims = sets.select("language", "modules", F.explode("module_metrics").alias("metric"))
    known = F.col("metric").isin(dims.MODULE_METRICS)
    no_modules = F.coalesce(F.size("modules"), F.lit(0)) < 1
    no_lines = ~F.coalesce(F.exists("modules", lambda m: F.size(m["lines"]) > 0), F.lit(False))
    _refuse(claims.where(~known | (F.col("metric") == "coupling") & no_modules | (F.col("metric") == "duplication") & no_lines).select("language", "metric"), "claims that are not borne out")
    return sets


def baseline(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A snapshot's languages; None where no path is given or no file is there. Broken JSON is an error."""
    if not path or not os.path.exists(path):
        return None
    return spark.read.schema(SNAPSHOT).option("mode", "FAILFAST").json(path, multiLine=True).select("taken", "rev", F.inline("languages"))


def _number(c: str):
    return F.coalesce(F.expr(f"try_cast(trim({c}) as int)"), F.lit(0))


def unit_inventory(spark: SparkSession, path: str) -> DataFrame:
    """An inventory CSV read by its header; other columns may follow. A number that is none is 0, a missing column an error."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST")
    wanted = "language element file line loc mccabe params".split()
    missing = [c for c in wanted if c not in raw.columns]
    if missing:
        raise ValueError(f"the inventory lacks {missing}")
    return raw.select("language", "element", normal_path(F.col("file")).alias("file"), *[_number(c).alias(c) for c in wanted[3:]])


def inventory_by_place(spark: SparkSession, path: str, language: str) -> DataFrame:
    """(file, line, name, loc, mccabe, params, ordinal) of one language, columns by place under a header line."""
    raw = spark.read.csv(path, header=False).withColumn("ordinal", F.monotonically_increasing_id())
    raw = raw.where((F.col("_c0") == language) & F.col("_c6").isNotNull())
    return raw.select(normal_path(F.col("_c2")).alias("file"), _number("_c3").alias("line"), F.col("_c1").alias("name"), _number("_c4").alias("loc"), _number("_c5").alias("mccabe"), _number("_c6").alias("params"), "ordinal")


def second_tool(spark: SparkSession, path: str) -> DataFrame:
    """The second tool's CSV: 11 columns and no header. anonymous marks rows without a name."""
    names = "nloc ccn token param length location file name long_name start end".split()
    raw = spark.read.csv(path, header=False, schema=", ".join(f"{n} string" for n in names)).withColumn("ordinal", F.monotonically_increasing_id())
    return raw.where(F.col("start").isNotNull()).select(
        normal_path(F.col("file")).alias("file"), _number("start").alias("line"), "name", _number("nloc").alias("loc"), _number("ccn").alias("mccabe"), _number("param").alias("params"), "ordinal", (F.trim(F.coalesce("name", F.lit(""))) == "").alias("anonymous")
    )


_BLOCK = r"^(.+):(\d+)\.(\d+),(\d+)\.(\d+) (\d+) (\d+)$"


def coverage_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, statements, hits, ordinal) of a coverage profile. The first line names the mode; any other
    line that is no block is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ordinal", "value"))
    return parse_coverage(lines)


def parse_coverage(lines: DataFrame) -> DataFrame:
    """coverage_blocks over (ordinal, value)."""
    rows = lines.withColumn("value", F.rtrim("value")).where((F.col("value") != "") & ~((F.col("ordinal") == 0) & F.col("value").startswith("mode:")))
    part = lambda k: F.regexp_extract("value", _BLOCK, k)
    checked = F.when(F.col("value").rlike(_BLOCK), part(1)).otherwise(F.raise_error(F.concat(F.lit("no coverage block: "), F.col("value"))))
    return rows.select(
        checked.alias("file"),
        F.concat_ws(",", F.concat_ws(".", part(2), part(3)), F.concat_ws(".", part(4), part(5))).alias("block"),
        part(6).cast("long").alias("statements"),
        part(7).cast("long").alias("hits"),
        F.col("ordinal").cast("long").alias("ordinal"),
    )


def coverage_floor(text: str) -> float:
    """The one number of a floor file, with or without a per cent sign, between 0 and 100."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    if len(lines) != 1 or not re.fullmatch(r"\d+(?:\.\d+)?%?", lines[0]):
        raise ValueError("a floor file holds one number")
    value = float(lines[0].rstrip("%"))
    if not 0 <= value <= 100:
        raise ValueError("a floor lies between 0 and 100")
    return value


def parse_changes(raw: str) -> list[tuple[str, str]]:
    """(status, path) of NUL-separated name-status output; renames and copies take the new path."""
    parts = raw.split("\0")
    out, i = [], 0
    while i < len(parts) and parts[i]:
        status = parts[i]
        step = 2 if status[0] in "RC" else 1
        if i + step >= len(parts):
            raise ValueError("the change list ends early")
        out.append((status[0], parts[i + step]))
        i += step + 1
    return out


def git_changes(spark: SparkSession, repo: str, base: str) -> DataFrame:
    """(status, path) of the files changed since base."""
    raw = subprocess.run(["git", "-C", repo, "diff", "--relative", "--name-status", "-z", base], check=True, capture_output=True, text=True).stdout
    return spark.createDataFrame(parse_changes(raw), "status string, path string")


def git_blobs(spark: SparkSession, repo: str, rev: str, paths: list[str]) -> DataFrame:
    """(path, body) at a revision; a path that is not there is left out."""
    rows = []
    for p in paths:
        got = subprocess.run(["git", "-C", repo, "show", f"{rev}:./{p}"], capture_output=True, text=True)
        if got.returncode == 0:
            rows.append((p, got.stdout))
    return spark.createDataFrame(rows, "path string, body string")


def git_patch(repo: str, rev: str, paths: list[str]) -> str:
    """The patch of these files since a revision; of none an empty one."""
    if not paths:
        return ""
    got = subprocess.run(["git", "-C", repo, "diff", rev, "--", *paths], capture_output=True, text=True)
    if got.returncode:
        raise ValueError(got.stderr.strip())
    return got.stdout


def tool_version(binary: str, *args: str) -> str:
    """What a tool says of itself."""
    got = subprocess.run([binary, *args], capture_output=True, text=True)
    return got.stdout + got.stderr


def issues(spark: SparkSession, path: str) -> DataFrame:
    """(number, title, body, state) of a tracker's JSON export."""
    return spark.read.schema("number long, title string, body string, state string").json(path, multiLine=True)
