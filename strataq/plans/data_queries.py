"""Queries and their SQL for the general data problems: percentiles, snapshots, two copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.common import table
from strataq.operators.inventories import unit_differences
from strataq.operators.percentiles import combine, combine_each, count_once, daily_counts, percentiles
from strataq.operators.snapshot_diff import snapshot_changes

PROBS = [("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
SINCE, UNTIL = "2031-02-01", "2031-02-28"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    funcs = count_once(table(spark, d, "func_metrics"), "metric_id", "received_at", ["scan_day", "module_path", "complexity", "tokens"])
    deps = count_once(table(spark, d, "file_deps"), "dep_id", "received_at", ["scan_day", "module_path", "span"])
    return daily_counts(funcs, "module_path", "scan_day", ["complexity", "tokens"]).unionByName(daily_counts(deps, "module_path", "scan_day", ["span"]))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Of every module for each day, each week and all days, all combined from the day results."""
    return percentiles(combine_each(_daily(spark, d), "module_path", "scan_day"), ["module_path", "day_range", "starts"], PROBS)


def p2_all_days(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(combine(_daily(spark, d), "module_path", "scan_day"), ["module_path"], PROBS)


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d)


def p2_range_of_days(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(combine(_daily(spark, d), "module_path", "scan_day", SINCE, UNTIL), ["module_path"], PROBS)


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "language_snapshots"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_changes(spark, d).select("root_path", "taken", "code_language", "measure_name", "kind")


def p4_differences(spark: SparkSession, d: str) -> DataFrame:
    return unit_differences(table(spark, d, "units"), table(spark, d, "units_copy"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_differences(spark, d).select("root_path", "file_name", "line_no", "kind", "field_name")


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_all_days, p2_daily, p2_range_of_days, p3_found, p3_changes, p4_found, p4_differences)}

_DAILY_SQL = """
WITH f AS (
  SELECT scan_day, module_path, complexity, tokens FROM (
    SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY received_at DESC, scan_day DESC, module_path DESC NULLS LAST, complexity DESC NULLS LAST, tokens DESC NULLS LAST) AS r
    FROM func_metrics) WHERE r = 1 OR metric_id IS NULL),
g AS (
  SELECT scan_day, module_path, span FROM (
    SELECT *, row_number() OVER (PARTITION BY dep_id ORDER BY received_at DESC, scan_day DESC, module_path DESC NULLS LAST, span DESC NULLS LAST) AS r
    FROM file_deps) WHERE r = 1 OR dep_id IS NULL),
m AS (
  SELECT 'complexity' AS measure_name, module_path, scan_day, CAST(complexity AS BIGINT) AS v FROM f
  UNION ALL SELECT 'tokens', module_path, scan_day, CAST(tokens AS BIGINT) FROM f
  UNION ALL SELECT 'span', module_path, scan_day, CAST(span AS BIGINT) FROM g),
b AS (SELECT *, CASE WHEN v < 1024 THEN 0 ELSE length(bin(v)) - 10 END AS s FROM m WHERE v IS NOT NULL),
daily AS (
  SELECT measure_name, module_path, scan_day,
         CASE WHEN s = 0 THEN v ELSE ((v >> s) << s) + (CAST(1 AS BIGINT) << (s - 1)) END AS value, count(*) AS n
  FROM b GROUP BY ALL)
"""
_PERCENTILE_SQL = """,
c AS (SELECT measure_name, {keys}, value, sum(n) AS n FROM {source} GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY measure_name, {keys} ORDER BY value) AS cum, sum(n) OVER (PARTITION BY measure_name, {keys}) AS total FROM c)
SELECT {keys}, measure_name, CAST(max(total) AS BIGINT) AS n, {cols} FROM w GROUP BY {keys}, measure_name
""".replace("{cols}", ", ".join(f"min(CASE WHEN cum >= ceil({q} * CAST(total AS DOUBLE)) THEN value END) AS {name}" for name, q in PROBS))
_EACH_SQL = """(
  SELECT *, 'day' AS day_range, scan_day AS starts FROM daily WHERE scan_day IS NOT NULL
  UNION ALL SELECT *, 'week', CAST(date_trunc('week', scan_day) AS DATE) FROM daily WHERE scan_day IS NOT NULL
  UNION ALL SELECT *, 'all', NULL FROM daily)"""

_P3_SQL = """
WITH d AS (
  SELECT root_path, taken, lower(regexp_replace(code_language, '^\\s+|\\s+$', '', 'g')) AS code_language, measures, entanglement,
         row_number() OVER (PARTITION BY root_path, taken, lower(regexp_replace(code_language, '^\\s+|\\s+$', '', 'g'))
                            ORDER BY delivered_at DESC, list_sort(map_entries(measures)) DESC) AS r FROM language_snapshots),
l AS (SELECT * FROM d WHERE r = 1),
e AS (
  SELECT root_path, taken, code_language, unnest(map_keys(measures)) AS measure_name, unnest(map_values(measures)) AS v, 10.0::DOUBLE AS scale FROM l
  UNION ALL
  SELECT root_path, taken, code_language, 'entanglement ' || k, v, CASE k WHEN 'density' THEN 100.0 WHEN 'violation_degree' THEN 1000.0 WHEN 'lines' THEN 1.0 WHEN 'violations' THEN 1.0 ELSE 10.0 END
  FROM (SELECT root_path, taken, code_language, unnest(map_keys(entanglement)) AS k, unnest(map_values(entanglement)) AS v FROM l)),
f AS (SELECT root_path, taken, code_language, measure_name, CAST(sign(v) * floor(abs(v * scale) + 0.5) AS BIGINT) AS figure, scale FROM e WHERE v IS NOT NULL AND NOT isnan(v)),
p AS (SELECT root_path, taken, lag(taken) OVER (PARTITION BY root_path ORDER BY taken) AS before FROM (SELECT DISTINCT root_path, taken FROM language_snapshots)),
n AS (SELECT f.* FROM f JOIN p ON f.root_path = p.root_path AND f.taken = p.taken WHERE p.before IS NOT NULL),
t AS (SELECT f.root_path, p.taken, f.code_language, f.measure_name, f.figure, f.scale FROM f JOIN p ON f.root_path = p.root_path AND f.taken = p.before)
SELECT coalesce(n.root_path, t.root_path) AS root_path, coalesce(n.taken, t.taken) AS taken, coalesce(n.code_language, t.code_language) AS code_language,
       coalesce(n.measure_name, t.measure_name) AS measure_name,
       CASE WHEN t.figure IS NULL THEN 'new' WHEN n.figure IS NULL THEN 'gone' ELSE 'moved' END AS kind{more}
FROM n FULL OUTER JOIN t ON n.root_path = t.root_path AND n.taken = t.taken AND n.code_language = t.code_language AND n.measure_name = t.measure_name
WHERE n.figure IS DISTINCT FROM t.figure
"""


def _side(name: str) -> str:
    num = "CASE WHEN {t} = '' THEN NULL ELSE coalesce(regexp_replace(regexp_replace(CAST(try_cast({t} AS DECIMAL(38,9)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), {t}) END"
    trim = "regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    cols = ", ".join(f"{num.format(t=trim.format(c=c))} AS {c}" for c in ("loc", "mccabe", "params"))
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_path, file_name, line_no ORDER BY exported_at DESC, element_name DESC NULLS LAST, loc DESC NULLS LAST, mccabe DESC NULLS LAST, params DESC NULLS LAST) AS r FROM "
        f"(SELECT root_path, regexp_replace(replace(file_name, '\\', '/'), '^(\\./+)+', '') AS file_name, line_no, exported_at, nullif({trim.format(c='element_name')}, '') AS element_name, {cols} FROM {name})) WHERE r = 1)"
    )


def _p4_sql(values: bool) -> str:
    fields = ("element_name", "loc", "mccabe", "params")
    key = "coalesce(a.root_path, b.root_path) AS root_path, coalesce(a.file_name, b.file_name) AS file_name, coalesce(a.line_no, b.line_no) AS line_no"
    nothing = ", CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value" if values else ""
    parts = [f"SELECT {key}, CASE WHEN b.r IS NULL THEN 'only_units' ELSE 'only_copy' END AS kind, '' AS field_name{nothing} FROM a FULL OUTER JOIN b ON {{on}} WHERE a.r IS NULL OR b.r IS NULL"]
    parts += [f"SELECT {key}, 'differs', '{c}'{f', a.{c}, b.{c}' if values else ''} FROM a JOIN b ON {{on}} WHERE a.{c} IS DISTINCT FROM b.{c}" for c in fields]
    on = "a.root_path IS NOT DISTINCT FROM b.root_path AND a.file_name IS NOT DISTINCT FROM b.file_name AND a.line_no IS NOT DISTINCT FROM b.line_no"
    return f"WITH a AS {_side('units')}, b AS {_side('units_copy')} " + " UNION ALL ".join(parts).replace("{on}", on)


SQL = {
    "p2_daily": _DAILY_SQL + "SELECT * FROM daily",
    "p2_percentiles": _DAILY_SQL + _PERCENTILE_SQL.replace("{source}", _EACH_SQL).replace("{keys}", "module_path, day_range, starts"),
    "p2_all_days": _DAILY_SQL + _PERCENTILE_SQL.replace("{source}", "daily").replace("{keys}", "module_path"),
    "p2_range_of_days": _DAILY_SQL + _PERCENTILE_SQL.replace("{source}", f"daily WHERE scan_day BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'").replace("{keys}", "module_path"),
    "p3_found": _P3_SQL.replace("{more}", ""),
    "p3_changes": _P3_SQL.replace("{more}", ", t.figure / t.scale AS then_figure, n.figure / n.scale AS now_figure"),
    "p4_found": _p4_sql(False),
    "p4_differences": _p4_sql(True),
}
