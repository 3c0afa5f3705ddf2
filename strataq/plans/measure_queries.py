"""Queries of the measurement operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq import dims
from strataq.common import table
from strataq.functions.text import is_filesystem_path
from strataq.operators import agreement, coupling, coverage, delta, duplication, graph, profile, review, rules, snapshots
from strataq.operators.inventories import KEY, number_text
from strataq.operators.inventories import normal_path as clean_path
from strataq.operators.percentiles import count_once

#: The columns each use keeps; a measurement counts once, and nothing else of it is read or moved.
RATED = ["module_path", "file_name", "element_name", "line_no", "tokens", "params", "complexity"]
SIZED = ["module_path", "loc", "mccabe", "params", "has_body"]
RATED_DEPS = ["module_path", "file_name", "volume", "span"]
LINKED = ["file_name", "targets", "scan_day"]
WEIGHED = ["file_name", "volume"]


def _six(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that two engines print them alike."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def functions(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return count_once(table(spark, d, "func_metrics"), "metric_id", "received_at", columns)


def dependencies(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return count_once(table(spark, d, "file_deps"), "dep_id", "received_at", columns)


def _once_sql(name: str, key: str, columns: list[str]) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in columns)
    return f"(SELECT {', '.join(columns)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY received_at DESC, {order}) AS rr FROM {name}) WHERE rr = 1 OR {key} IS NULL)"


RATED_SQL, SIZED_SQL = (_once_sql("func_metrics", "metric_id", c) for c in (RATED, SIZED))
RATED_DEPS_SQL, LINKED_SQL, WEIGHED_SQL = (_once_sql("file_deps", "dep_id", c) for c in (RATED_DEPS, LINKED, WEIGHED))

# --- banded rules over measured functions and files

_RATED = [("FUNCTION_SIZE_RISK", "tokens", "function size in tokens"), ("PARAMETER_RISK", "params", "parameters"), ("FUNCTION_COMPLEXITY_RISK", "complexity", "cognitive complexity")]
_RATED_DEPS = [("DEPENDENCY_VOLUME_RISK", "volume", "dependency volume"), ("DEPENDENCY_SPAN_RISK", "span", "dependency span")]


def rated(spark: SparkSession, d: str) -> DataFrame:
    funcs = functions(spark, d, RATED).select(F.col("module_path").alias("module"), F.col("element_name").alias("element"), F.col("file_name").alias("file"), F.col("line_no").alias("line"), "tokens", "params", "complexity")
    deps = dependencies(spark, d, RATED_DEPS).select(F.col("module_path").alias("module"), F.element_at(F.split("file_name", "/"), -1).alias("element"), F.col("file_name").alias("file"), F.lit(1).alias("line"), "volume", "span")
    parts = [rules.banded(funcs, r, c, u, dims.BANDS[r]) for r, c, u in _RATED] + [rules.banded(deps, r, c, u, dims.BANDS[r]) for r, c, u in _RATED_DEPS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rated_sql() -> str:
    def one(rule: str, column: str, unit: str, source: str, element: str, line: str) -> str:
        high, very = dims.BANDS[rule]
        c = f"CAST({column} AS BIGINT)"
        return (
            f"SELECT module_path AS module, '{rule}' AS rule, {element} AS element, '{unit}: ' || {c} || ' ' || CASE WHEN {c} > {very} THEN '(very high risk, [> {very}])' ELSE '(high risk, [{high + 1} - {very}])' END AS description, "
            f"file_name AS file, {line} AS line, CASE WHEN {c} > {very} THEN 'very high risk' ELSE 'high risk' END AS severity, {c} AS value FROM {source} WHERE {column} > {high}"
        )

    parts = [one(r, c, u, RATED_SQL, "element_name", "line_no") for r, c, u in _RATED] + [one(r, c, u, RATED_DEPS_SQL, "regexp_extract(file_name, '[^/]*$')", "1") for r, c, u in _RATED_DEPS]
    return " UNION ALL ".join(parts)


def band_rating(spark: SparkSession, d: str) -> DataFrame:
    return rated(spark, d)


def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.counts(rated(spark, d))


def sectioned_rows(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("value").desc(), "file", "line", "element", "module"]
    return review.sectioned(rated(spark, d), order).select("rule", "rank", "id", "element", "file", "line", "severity", "value")


def top_findings(spark: SparkSession, d: str) -> DataFrame:
    """The 25 worst findings of each rule and how many more there are: a report that shows a top."""
    order = [F.col("value").desc(), "file", "line", "element", "module"]
    return review.top(rated(spark, d), ["rule"], order, 25).select("rule", "place", "file", "element", "value", "more")


_RULES_SQL = "(VALUES " + ", ".join(f"('{r}', {i})" for i, r in enumerate(dims.RULES)) + ") AS t(rule, rank)"
_ORDER_SQL = "value DESC, file, line, element, module NULLS FIRST"

# --- profiles


def _units(spark: SparkSession, d: str) -> DataFrame:
    return functions(spark, d, SIZED).where("module_path IS NOT NULL AND has_body").select("module_path", "loc", "mccabe", "params")


_UNITS_SQL = f"(SELECT module_path, CAST(loc AS BIGINT) AS loc, CAST(mccabe AS BIGINT) AS mccabe, CAST(params AS BIGINT) AS params FROM {SIZED_SQL} WHERE module_path IS NOT NULL AND has_body AND loc IS NOT NULL)"
_ROLLED_SQL = f"(SELECT module_path, loc, mccabe, params FROM {_UNITS_SQL} UNION ALL SELECT 'combined', loc, mccabe, params FROM {_UNITS_SQL})"


def category_shares(spark: SparkSession, d: str) -> DataFrame:
    return _six(profile.category_shares(_units(spark, d), "module_path"))


def _category_sql() -> str:
    parts = []
    for p, (c, bands, _) in dims.UNIT_PROPERTIES.items():
        for name, low, high in bands:
            held = f"{c} BETWEEN {low} AND {high}"
            parts.append(
                f"SELECT module_path, '{p}' AS property, '{name}' AS category, count(*) FILTER (WHERE {held}) AS elements, CAST(coalesce(sum(loc) FILTER (WHERE {held}), 0) AS BIGINT) AS loc, "
                f"round(coalesce(sum(loc) FILTER (WHERE {held}), 0) / CAST(sum(loc) AS DOUBLE) * 100, 6) AS pct FROM r GROUP BY module_path HAVING sum(loc) > 0"
            )
    return f"WITH r AS {_ROLLED_SQL} " + " UNION ALL ".join(parts)


def tail_shares(spark: SparkSession, d: str) -> DataFrame:
    return _six(profile.tail_shares(_units(spark, d), "module_path"))


def _tail_sql() -> str:
    parts = []
    for p, (c, _, tails) in dims.UNIT_PROPERTIES.items():
        for t, inclusive, cap in tails:
            held = f"{c} {'>=' if inclusive else '>'} {t}"
            parts.append(
                f"SELECT module_path, '{p}' AS property, '{profile.tail_label(t, inclusive)}' AS tail, CAST({cap} AS DOUBLE) AS cap_pct, count(*) FILTER (WHERE {held}) AS elements, "
                f"CAST(coalesce(sum(loc) FILTER (WHERE {held}), 0) AS BIGINT) AS loc, CAST(sum(loc) AS BIGINT) AS total FROM r GROUP BY module_path HAVING sum(loc) > 0"
            )
    pct = "CAST(loc AS DOUBLE) / CAST(total AS DOUBLE) * 100"
    return (
        f"WITH r AS {_ROLLED_SQL}, t AS ({' UNION ALL '.join(parts)}) SELECT module_path, property, tail, cap_pct, elements, loc, total, round({pct}, 6) AS pct, {pct} <= cap_pct AS pass, abs({pct} - cap_pct) <= 0.05::DOUBLE AS at_cap, "
        f"CASE WHEN {pct} <= cap_pct THEN 0 ELSE CAST(ceil(loc - cap_pct / 100 * total) AS BIGINT) END AS excess_loc FROM t"
    )


def snapshot_measures(spark: SparkSession, d: str) -> DataFrame:
    measured = snapshots.tail_measures(profile.tail_shares(_units(spark, d), "module_path"), "module_path")
    return measured.select("module_path", F.explode("measures").alias("measure", "figure"))


def standing(spark: SparkSession, d: str) -> DataFrame:
    """Tails within and over their cap per module, none of them with a recorded deviation."""
    tails = profile.with_deviations(profile.tail_shares(_units(spark, d), "module_path"), "module_path", spark.createDataFrame([], "language string, property string, tail string, decided string, ref string, summary string"))
    return profile.standing(tails, "module_path")


def distances(spark: SparkSession, d: str) -> DataFrame:
    return profile.distances(profile.tail_shares(_units(spark, d), "module_path"), "module_path")


def _inventory(spark: SparkSession, d: str, name: str) -> DataFrame:
    lang = F.lower(F.trim("code_language"))
    cols = ["element_name", "loc", "mccabe", "params"]
    rows = table(spark, d, name).select("root_path", clean_path(F.col("file_name")).alias("file_name"), "line_no", "exported_at", lang.alias("language"), "element_name", *[number_text(F.col(c)).try_cast("double").cast("int").alias(c) for c in cols[1:]])
    last = rows.groupBy(*KEY).agg(F.max(F.struct("exported_at", "loc", "mccabe", "params", "language", "element_name")).alias("r"))
    return last.select(*KEY, "r.*")


def _inventory_sql(name: str) -> str:
    num = "CAST(try_cast(regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g') AS DOUBLE) AS INTEGER) AS {c}"
    cols = ", ".join(num.format(c=c) for c in ("loc", "mccabe", "params"))
    inner = f"SELECT root_path, regexp_replace(replace(file_name, '\\', '/'), '^(\\./+)+', '') AS file_name, line_no, exported_at, lower(trim(code_language)) AS language, element_name, {cols} FROM {name}"
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_path, file_name, line_no ORDER BY exported_at DESC, loc DESC NULLS LAST, mccabe DESC NULLS LAST, params DESC NULLS LAST, language DESC NULLS LAST, element_name DESC NULLS LAST) AS rr FROM ({inner})) WHERE rr = 1)"


def volume_years(spark: SparkSession, d: str) -> DataFrame:
    units = _inventory(spark, d, "units").where("language IS NOT NULL")
    return _six(profile.volume(profile.language_totals(units, "language"), "language"))


def language_totals(spark: SparkSession, d: str) -> DataFrame:
    return _six(profile.language_totals(_inventory(spark, d, "units").where("language IS NOT NULL"), "language"))


# --- change and agreement between two inventories


def delta_files(spark: SparkSession, d: str) -> DataFrame:
    return delta.delta_files(_inventory(spark, d, "units"), _inventory(spark, d, "units_copy"), "root_path", "file_name")


def delta_scores(spark: SparkSession, d: str) -> DataFrame:
    return _six(delta.delta_scores(delta_files(spark, d), "root_path"))


def _delta_sql() -> str:
    sums, outs, touched = [], [], []
    for p, (c, most) in dims.DELTA_PROPERTIES.items():
        sums += [f"sum(CASE WHEN coalesce({c}, 0) <= {most} THEN coalesce(loc, 0) ELSE 0 END) AS low_{p}", f"sum(CASE WHEN coalesce({c}, 0) <= {most} THEN 0 ELSE coalesce(loc, 0) END) AS high_{p}"]
        low, high = (f"(coalesce(b.{k}_{p}, 0) - coalesce(a.{k}_{p}, 0))" for k in ("low", "high"))
        outs += [f"CAST(greatest({low}, 0) + greatest(-{high}, 0) AS BIGINT) AS good_{p}", f"CAST(greatest(-{low}, 0) + greatest({high}, 0) AS BIGINT) AS bad_{p}"]
        touched.append(f"{low} <> 0 OR {high} <> 0")
    side = lambda n: f"(SELECT root_path, file_name, {', '.join(sums)} FROM {_inventory_sql(n)} GROUP BY ALL)"
    return (
        f"SELECT coalesce(a.root_path, b.root_path) AS root_path, coalesce(a.file_name, b.file_name) AS file_name, a.root_path IS NULL AS added, b.root_path IS NULL AS removed, ({' OR '.join(touched)}) AS touched, {', '.join(outs)} "
        f"FROM {side('units')} a FULL OUTER JOIN {side('units_copy')} b ON a.root_path = b.root_path AND a.file_name = b.file_name"
    )


def _delta_scores_sql() -> str:
    parts = [
        f"SELECT root_path, '{p}' AS property, CAST(sum(good_{p}) AS BIGINT) AS good, CAST(sum(bad_{p}) AS BIGINT) AS bad, count(*) FILTER (WHERE touched) AS files_touched, count(*) FILTER (WHERE added) AS files_added, count(*) FILTER (WHERE removed) AS files_removed, "
        f"round(CAST(sum(good_{p}) AS DOUBLE) / nullif(sum(good_{p}) + sum(bad_{p}), 0), 6) AS score FROM f GROUP BY root_path"
        for p in dims.DELTA_PROPERTIES
    ]
    return f"WITH f AS ({_delta_sql()}) " + " UNION ALL ".join(parts)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return agreement.matched(_inventory(spark, d, "units"), _inventory(spark, d, "units_copy"), KEY, ["loc", "mccabe", "params"], "exported_at")


def agreement_stats(spark: SparkSession, d: str) -> DataFrame:
    return _six(agreement.agreement_stats(_pairs(spark, d)))


def worst_divergence(spark: SparkSession, d: str) -> DataFrame:
    """The ten pairs farthest apart: a report that shows a top."""
    return _six(agreement.worst_divergence(_pairs(spark, d), 10))


_PAIRS_SQL = "(" + " UNION ALL ".join(f"SELECT a.root_path, a.file_name, a.line_no, '{m}' AS measure, CAST(a.{m} AS DOUBLE) AS ours, CAST(b.{m} AS DOUBLE) AS theirs, a.{m} / nullif(CAST(b.{m} AS DOUBLE), 0) AS ratio FROM a JOIN b USING (root_path, file_name, line_no) WHERE a.{m} IS NOT NULL AND b.{m} IS NOT NULL" for m in ("loc", "mccabe", "params")) + ")"
_SIDES_SQL = f"WITH a AS {_inventory_sql('units')}, b AS {_inventory_sql('units_copy')}, p AS {_PAIRS_SQL} "

# --- coupling between files and components


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, refs) of the dependency history, every file once per target and day."""
    return dependencies(spark, d, LINKED).where("targets IS NOT NULL").select(F.col("file_name").alias("source"), F.explode("targets").alias("target"), F.lit(1).cast("long").alias("refs"))


def _map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "modules").where("component_name IS NOT NULL AND component_name <> ''").select(F.col("component_name").alias("component"), F.col("module_path").alias("path"))


def longest_prefix_owner(spark: SparkSession, d: str) -> DataFrame:
    files = dependencies(spark, d, WEIGHED).select("file_name").distinct()
    return coupling.owners(files, "file_name", _map(spark, d))


def _owned(spark: SparkSession, d: str) -> DataFrame:
    edges = _targets(spark, d).where("source <> target")
    c = _map(spark, d)
    a = coupling.owners(edges, "source", c).withColumnRenamed("component", "source_component")
    return coupling.owners(a, "target", c).withColumnRenamed("component", "target_component")


def fan_in(spark: SparkSession, d: str) -> DataFrame:
    return coupling.fan_in(_owned(spark, d), "source", "target", "refs", "source_component", "target_component")


def component_edges(spark: SparkSession, d: str) -> DataFrame:
    return coupling.component_edges(_owned(spark, d), "source_component", "target_component", "source", "target")


def _modules(spark: SparkSession, d: str) -> DataFrame:
    files = dependencies(spark, d, WEIGHED).groupBy(F.col("file_name").alias("file")).agg(F.coalesce(F.max("volume"), F.lit(0)).alias("loc"))
    return coupling.owners(coupling.measured_modules(files, "file", fan_in(spark, d), "target"), "file", _map(spark, d))


def independence(spark: SparkSession, d: str) -> DataFrame:
    return _six(coupling.independence(_modules(spark, d), dims.INDEPENDENCE_FLOOR))


def component_shares(spark: SparkSession, d: str) -> DataFrame:
    return _six(coupling.component_shares(_modules(spark, d)))


def coupling_tails(spark: SparkSession, d: str) -> DataFrame:
    units = _modules(spark, d).withColumnRenamed("in_modules", "incoming").withColumn("language", F.lit("go"))
    return _six(profile.tail_shares(units, "language", dims.MODULE_PROPERTIES))


def direct_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.direct_cycles(component_edges(spark, d))


def component_violations(spark: SparkSession, d: str) -> DataFrame:
    return graph.violations(component_edges(spark, d).withColumn("language", F.lit("go")), "language")


def entanglement(spark: SparkSession, d: str) -> DataFrame:
    return _six(graph.entanglement(component_edges(spark, d).withColumn("language", F.lit("go")), "language"))


def scc_members(spark: SparkSession, d: str) -> DataFrame:
    """Components in a cycle of lines."""
    return graph.strong_components(component_edges(spark, d).withColumn("language", F.lit("go")), "language", "from", "to").select("component", "node")


_OWN_SQL = """
e AS (SELECT DISTINCT file_name AS source, unnest(targets) AS target, scan_day FROM {l}),
m AS (SELECT component_name AS component, module_path AS path FROM modules WHERE component_name IS NOT NULL AND component_name <> ''),
n AS (SELECT source AS f FROM e UNION SELECT target FROM e UNION SELECT file_name FROM {w}),
o AS (SELECT f, arg_max(component, length(path)) AS component FROM n JOIN m ON starts_with(f, path || '/') OR f = path GROUP BY f),
x AS (SELECT t.source, t.target, a.component AS sc, b.component AS tc, count(*) AS refs FROM (SELECT file_name AS source, unnest(targets) AS target FROM {l}) t
      LEFT JOIN o a ON t.source = a.f LEFT JOIN o b ON t.target = b.f WHERE t.source <> t.target GROUP BY ALL),
fan AS (SELECT target, count(*) AS in_modules, CAST(sum(refs) AS BIGINT) AS in_refs, count(*) FILTER (WHERE sc IS DISTINCT FROM tc) AS in_cross_component FROM x GROUP BY target),
ce AS (SELECT sc AS "from", tc AS "to", count(*) AS weight FROM x WHERE sc <> tc GROUP BY ALL),
mods AS (SELECT g.file, CAST(g.loc AS BIGINT) AS loc, coalesce(fan.in_modules, 0) AS in_modules, coalesce(fan.in_cross_component, 0) AS in_cross_component, o.component
         FROM (SELECT file_name AS file, coalesce(max(volume), 0) AS loc FROM {w} GROUP BY 1) g LEFT JOIN fan ON g.file = fan.target LEFT JOIN o ON g.file = o.f)
""".replace("{l}", LINKED_SQL).replace("{w}", WEIGHED_SQL)

# --- coverage and review over events

_SRC = "concat('pkg', cast(user_id % 40 as string), '/f', cast(user_id as string), '.go')"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.expr(_SRC).alias("file"), F.col("event_type").alias("block"), (F.col("user_id") % 7 + 1).alias("statements"), F.when(F.col("value") > 60, 1).otherwise(0).alias("hits"), F.col("event_id").alias("ordinal"))


def _covered(spark: SparkSession, d: str) -> DataFrame:
    files = coverage.covered_files(_blocks(spark, d))
    return coverage.classified(files, files.select("file", F.col("file").rlike(r"[05]\.go$").alias("generated")))


def coverage_packages(spark: SparkSession, d: str) -> DataFrame:
    return _six(coverage.packages(_covered(spark, d)))


def coverage_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _six(coverage.verdict(_covered(spark, d), 80.0))


_COV_SQL = """
b AS (SELECT 'pkg' || (user_id % 40) || '/f' || user_id || '.go' AS file, event_type AS block, arg_min(user_id % 7 + 1, event_id) AS statements, max(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS hits FROM events GROUP BY ALL),
f AS (SELECT file, regexp_matches(file, '[05]\\.go$') AS generated, CAST(sum(statements) AS BIGINT) AS statements, CAST(sum(CASE WHEN hits > 0 THEN statements ELSE 0 END) AS BIGINT) AS covered FROM b GROUP BY ALL)
"""


def _event_findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events").select(F.lit("NESTED_LOOP").alias("rule"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_type").alias("element"), F.col("event_id").alias("line"))
    reviewed = events.select("rule", "file", "element").distinct().select("*", (F.length("element") % 5 + 1).cast("int").alias("count"), F.lit("2031-01-01").alias("reviewed"), F.concat(F.lit("bounded by "), "element").alias("reason"), F.lit("").alias("ref"))
    return events, reviewed.where(F.col("file").rlike("[0369]$"))


_KEYS = ["rule", "file", "element"]


def acceptance_open(spark: SparkSession, d: str) -> DataFrame:
    return review.apply_acceptances(*_event_findings(spark, d), _KEYS, ["line"]).where("NOT accepted").drop("accepted")


def acceptance_stale(spark: SparkSession, d: str) -> DataFrame:
    findings, reviewed = _event_findings(spark, d)
    return review.stale_acceptances(findings, reviewed.withColumn("count", F.col("count") * 8), _KEYS).select(*_KEYS, F.col("count").cast("long").alias("count"), F.col("matched").cast("long").alias("matched"))


_ACC_SQL = """
e AS (SELECT 'NESTED_LOOP' AS rule, 'u' || user_id AS file, event_type AS element, event_id AS line FROM events),
a AS (SELECT DISTINCT rule, file, element, length(element) % 5 + 1 AS budget FROM e WHERE regexp_matches(file, '[0369]$'))
"""

# --- duplication and text over documents


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return duplication.text_lines(table(spark, d, "documents"), "doc_id", "text")


def duplication_lines(spark: SparkSession, d: str) -> DataFrame:
    return duplication.redundant_lines(_lines(spark, d), ["doc_id"]).select("doc_id", F.col("i").cast("long").alias("i"))


def duplication_summary(spark: SparkSession, d: str) -> DataFrame:
    return _six(duplication.duplication(_lines(spark, d), ["doc_id"]))


def duplication_by_document(spark: SparkSession, d: str) -> DataFrame:
    return _six(duplication.module_duplication(_lines(spark, d), ["doc_id"]))


_DUP_SQL = """
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
nb AS (SELECT doc_id, k, trim(regexp_replace(l, '[ \\t\\r\\f\\v]+', ' ', 'g')) AS l FROM raw),
ln AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM nb WHERE l <> ''),
fr AS (SELECT doc_id, i, string_agg(l, chr(10)) OVER w AS t, count(*) OVER w AS n FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
oc AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM fr WHERE n = 6),
red AS (SELECT DISTINCT doc_id, i + unnest(range(6)) AS i FROM oc WHERE r > 1)
"""


def license_notices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where(F.col("body").rlike(dims.NOTICE)).select("file_id")


def unfinished_notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").rlike(dims.UNFINISHED)).select("doc_id")


def path_literals(spark: SparkSession, d: str) -> DataFrame:
    """What stands between backquotes, whether it names a place in a file system, and how often it stands there."""
    quoted = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("`([^`\\n]+)`"), F.lit(1))).alias("value"))
    return quoted.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("is_path", is_filesystem_path(F.col("value")))


_W = "(^|[^0-9A-Za-z_])"
_E = "($|[^0-9A-Za-z_])"
_ROOTS = "|".join(dims.FILESYSTEM_ROOTS)
_PATH_SQL = f"""
WITH q AS (SELECT unnest(regexp_extract_all(text, '`([^`\\n]+)`', 1)) AS value FROM documents),
g AS (SELECT value, count(*) AS n, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS s FROM q GROUP BY value)
SELECT value, n, s <> '' AND strlen(s) <= 200 AND NOT regexp_matches(s, '[ \\t\\n"''?<>{{}}|]') AND NOT regexp_matches(s, '{_W}[a-zA-Z][a-zA-Z0-9+.\\-]*://[^\\s"''<>)\\\\]+') AND NOT regexp_matches(s, '{dims.MIME_TYPE}')
  AND (regexp_matches(s, '^[A-Za-z]:[\\\\/]') OR regexp_matches(s, '^~[\\\\/]') OR CASE WHEN starts_with(s, '/') THEN regexp_matches(s, '^/({_ROOTS})/') OR (length(s) - length(replace(s, '/', '')) >= 2 AND contains(regexp_extract(s, '[^/]*$'), '.'))
       ELSE regexp_matches(s, '{dims.RELATIVE_PATH}') END) AS is_path
FROM g
"""

QUERIES = {
    f.__name__: f
    for f in (
        band_rating, finding_counts, sectioned_rows, top_findings, category_shares, tail_shares, snapshot_measures, standing, distances, volume_years, language_totals, delta_files, delta_scores, agreement_stats, worst_divergence,
        longest_prefix_owner, fan_in, component_edges, independence, component_shares, coupling_tails, direct_cycles, component_violations, entanglement, scc_members, coverage_packages, coverage_verdict, acceptance_open, acceptance_stale,
        duplication_lines, duplication_summary, duplication_by_document, license_notices, unfinished_notes, path_literals,
    )
}

_COUPLING_TAIL = " UNION ALL ".join(
    f"SELECT l AS language, 'module_coupling' AS property, '> {t}' AS tail, CAST({cap} AS DOUBLE) AS cap_pct, count(*) FILTER (WHERE in_modules > {t}) AS elements, CAST(coalesce(sum(loc) FILTER (WHERE in_modules > {t}), 0) AS BIGINT) AS loc, CAST(sum(loc) AS BIGINT) AS total FROM mods, (VALUES ('go'), ('combined')) v(l) GROUP BY l"
    for t, _, cap in dims.MODULE_PROPERTIES["module_coupling"][2]
)
_CPCT = "CAST(loc AS DOUBLE) / total * 100"
SQL = {
    "band_rating": _rated_sql(),
    "finding_counts": f"WITH x AS ({_rated_sql()}) SELECT t.rule, count(x.rule) AS findings, count(*) FILTER (WHERE x.severity = 'high risk') AS high, count(*) FILTER (WHERE x.severity = 'very high risk') AS very_high, count(DISTINCT x.file) AS files FROM {_RULES_SQL} LEFT JOIN x ON x.rule = t.rule GROUP BY t.rule",
    "sectioned_rows": f"WITH x AS ({_rated_sql()}) SELECT t.rule, t.rank, x.id, x.element, x.file, x.line, x.severity, x.value FROM {_RULES_SQL} LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY {_ORDER_SQL}) AS id FROM x) x ON x.rule = t.rule",
    "top_findings": f"WITH x AS ({_rated_sql()}), y AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY {_ORDER_SQL}) AS place, greatest(count(*) OVER (PARTITION BY rule) - 25, 0) AS more FROM x) SELECT rule, place, file, element, value, more FROM y WHERE place <= 25",
    "category_shares": _category_sql(),
    "tail_shares": _tail_sql(),
    "snapshot_measures": f"WITH z AS ({_tail_sql().replace('round(', '(').replace(', 6) AS pct', ') AS pct')}) SELECT module_path, property || ' ' || tail AS measure, floor(pct * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS figure FROM z",
    "standing": f"WITH z AS ({_tail_sql()}) SELECT module_path, count(*) FILTER (WHERE pass) AS within, count(*) FILTER (WHERE NOT pass) AS over, CAST(0 AS BIGINT) AS deviated, bool_and(pass) AS eligible FROM z WHERE module_path <> 'combined' GROUP BY 1",
    "distances": f"WITH z AS ({_tail_sql()}) SELECT module_path, property, max(excess_loc) AS excess_loc FROM z WHERE module_path <> 'combined' GROUP BY 1, 2 HAVING max(excess_loc) > 0",
    "volume_years": f"WITH u AS (SELECT language, count(*) AS units, CAST(coalesce(sum(loc), 0) AS BIGINT) AS loc FROM {_inventory_sql('units')} WHERE language IS NOT NULL GROUP BY 1), v AS (SELECT * FROM (VALUES {', '.join(f'({k.lower()!r}, {n})' for k, n in dims.LINES_PER_BUDGET.items())}) AS t(k, n)) SELECT language, loc, n AS lines_per_budget, round(CAST(loc AS DOUBLE) / n * {dims.BUDGET_YEARS}::DOUBLE, 6) AS years FROM u LEFT JOIN v ON k = language",
    "language_totals": f"WITH u AS (SELECT unnest([language, 'combined']) AS language, loc FROM {_inventory_sql('units')} WHERE language IS NOT NULL) SELECT language, count(*) AS units, CAST(coalesce(sum(loc), 0) AS BIGINT) AS unit_loc, CAST(0 AS BIGINT) AS non_unit_loc, CAST(0 AS DOUBLE) AS non_unit_pct, count(*) > 0 AND coalesce(sum(loc), 0) > 0 AS measured FROM u GROUP BY 1",
    "delta_files": _delta_sql(),
    "delta_scores": _delta_scores_sql(),
    "agreement_stats": _SIDES_SQL + "SELECT measure, count(*) AS matched, count(*) FILTER (WHERE ours = theirs) AS equal, count(*) FILTER (WHERE ratio < 0.75 OR ratio > 1.33) AS outside, round(quantile_cont(ratio, 0.5), 6) AS median_ratio FROM p GROUP BY 1",
    "worst_divergence": _SIDES_SQL + "SELECT root_path, file_name, line_no, measure, ours, theirs, round(ratio, 6) AS ratio, round(CASE WHEN ratio = 0 THEN 'infinity'::DOUBLE ELSE abs(ln(ratio)) END, 6) AS distance FROM p WHERE ratio IS NOT NULL AND ratio <> 1 ORDER BY CASE WHEN ratio = 0 THEN 'infinity'::DOUBLE ELSE abs(ln(ratio)) END DESC, root_path, file_name, line_no, measure LIMIT 10",
    "longest_prefix_owner": f"WITH {_OWN_SQL} SELECT DISTINCT d.file_name, o.component FROM {WEIGHED_SQL} d LEFT JOIN o ON o.f = d.file_name",
    "fan_in": f"WITH {_OWN_SQL} SELECT * FROM fan",
    "component_edges": f"WITH {_OWN_SQL} SELECT * FROM ce",
    "independence": f"WITH {_OWN_SQL}, t AS (SELECT CAST(coalesce(sum(CASE WHEN in_cross_component = 0 THEN loc ELSE 0 END), 0) AS BIGINT) AS h, CAST(sum(loc) AS BIGINT) AS t FROM mods) SELECT h AS hidden_loc, t AS total_loc, round(h / CAST(t AS DOUBLE) * 100, 6) AS pct, 93.7::DOUBLE AS floor_pct, h / CAST(t AS DOUBLE) * 100 >= 93.7 AS pass, CASE WHEN h / CAST(t AS DOUBLE) * 100 >= 93.7 THEN 0 ELSE CAST(floor(t * 93.7::DOUBLE / 100) AS BIGINT) - h END AS exposed_loc FROM t WHERE t > 0",
    "component_shares": f"WITH {_OWN_SQL} SELECT component, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(CASE WHEN in_cross_component > 0 THEN loc ELSE 0 END) AS BIGINT) AS exposed, round(coalesce(sum(CASE WHEN in_cross_component > 0 THEN loc ELSE 0 END) / nullif(CAST(sum(loc) AS DOUBLE), 0) * 100, 0), 6) AS exposed_pct FROM mods GROUP BY component",
    "coupling_tails": f"WITH {_OWN_SQL}, t AS ({_COUPLING_TAIL}) SELECT language, property, tail, cap_pct, elements, loc, total, round({_CPCT}, 6) AS pct, {_CPCT} <= cap_pct AS pass, abs({_CPCT} - cap_pct) <= 0.05::DOUBLE AS at_cap, CASE WHEN {_CPCT} <= cap_pct THEN 0 ELSE CAST(ceil(loc - cap_pct / 100 * total) AS BIGINT) END AS excess_loc FROM t",
    "direct_cycles": f"WITH {_OWN_SQL} SELECT a.\"from\" AS a, a.\"to\" AS b, least(a.weight, b.weight) AS weight, CASE WHEN a.weight <= b.weight THEN a.\"from\" ELSE a.\"to\" END AS lighter_from, CASE WHEN a.weight <= b.weight THEN a.\"to\" ELSE a.\"from\" END AS lighter_to FROM ce a JOIN ce b ON a.\"from\" = b.\"to\" AND a.\"to\" = b.\"from\" WHERE a.\"from\" < a.\"to\"",
    "scc_members": f"WITH RECURSIVE {_OWN_SQL}, s AS (SELECT \"from\" AS a, \"to\" AS b FROM ce), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a), mm AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT max(greatest(node, other)) AS component, node FROM mm GROUP BY node HAVING count(*) FILTER (WHERE other <> node) > 0",
    "coverage_packages": f"WITH {_COV_SQL} SELECT regexp_replace(file, '/[^/]*$', '') AS package, count(*) AS files, CAST(sum(statements) AS BIGINT) AS statements, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(statements) - sum(covered) AS BIGINT) AS uncovered, round(sum(covered) / CAST(sum(statements) AS DOUBLE) * 100, 6) AS pct FROM f WHERE NOT generated GROUP BY 1",
    "coverage_verdict": f"WITH {_COV_SQL}, t AS (SELECT CAST(sum(CASE WHEN generated THEN 0 ELSE statements END) AS BIGINT) AS statements, CAST(sum(CASE WHEN generated THEN 0 ELSE covered END) AS BIGINT) AS covered, CAST(sum(CASE WHEN generated THEN statements ELSE 0 END) AS BIGINT) AS generated_statements FROM f), u AS (SELECT *, covered / CAST(statements AS DOUBLE) * 100 AS p FROM t) "
    "SELECT statements, covered, generated_statements, round(p, 6) AS pct, p < 80 AS breached, greatest(CAST(floor(covered * 100 / 80.0::DOUBLE) AS BIGINT) - statements, 0) AS headroom, greatest(CAST(ceil(0.8::DOUBLE * statements) AS BIGINT) - covered, 0) AS shortfall, round(CASE WHEN floor((p - 0.2::DOUBLE) * 10) / 10 - 80 >= 1 THEN floor((p - 0.2::DOUBLE) * 10) / 10 END, 6) AS raise_to FROM u",
    "acceptance_open": f"WITH {_ACC_SQL}, r AS (SELECT e.*, row_number() OVER (PARTITION BY rule, file, element ORDER BY line) AS n FROM e) SELECT r.rule, r.file, r.element, r.line FROM r LEFT JOIN a USING (rule, file, element) WHERE n > coalesce(budget, 0)",
    "acceptance_stale": f"WITH {_ACC_SQL}, c AS (SELECT rule, file, element, count(*) AS n FROM e GROUP BY ALL) SELECT rule, file, element, CAST(budget * 8 AS BIGINT) AS count, least(n, budget * 8) AS matched FROM a JOIN c USING (rule, file, element) WHERE n < budget * 8",
    "duplication_lines": f"WITH {_DUP_SQL} SELECT doc_id, i FROM red",
    "duplication_summary": f"WITH {_DUP_SQL}, t AS (SELECT (SELECT count(*) FROM red) AS r, (SELECT count(*) FROM ln) AS n), u AS (SELECT *, r / CAST(n AS DOUBLE) * 100 AS p FROM t) SELECT r AS redundant_loc, n AS total_loc, round(p, 6) AS pct, p <= 5.6 AS pass, abs(p - 5.6::DOUBLE) <= 0.05::DOUBLE AS at_cap, CASE WHEN p <= 5.6 THEN 0 ELSE CAST(floor(r - 5.6::DOUBLE / 100 * n + 0.999999::DOUBLE) AS BIGINT) END AS excess_loc FROM u",
    "duplication_by_document": f"WITH {_DUP_SQL} SELECT doc_id, l.loc, r.redundant_loc, round(redundant_loc / CAST(loc AS DOUBLE) * 100, 6) AS pct FROM (SELECT doc_id, count(*) AS loc FROM ln GROUP BY 1) l JOIN (SELECT doc_id, count(*) AS redundant_loc FROM red GROUP BY 1) r USING (doc_id)",
    "license_notices": f"SELECT file_id FROM source_files WHERE regexp_matches(body, '(?i){_W}copyright($|[^0-9A-Za-z_])') AND regexp_matches(body, '(?i){_W}copyright\\s*(\\(c\\)|©|\\d{{4}})') OR regexp_matches(body, '{_W}(?i:SPDX-License-Identifier){_E}') OR regexp_matches(body, '(?i){_W}all rights reserved{_E}') OR regexp_matches(body, '(?i){_W}licensed under (the )?(MIT|Apache|BSD|GNU|GPL|LGPL|MPL|ISC){_E}')",
    "unfinished_notes": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_W}(TODO|FIXME|XXX|HACK){_E}')",
    "path_literals": _PATH_SQL,
}
