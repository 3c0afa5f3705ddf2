"""Queries of the source-scanning operators over source_files, with their SQL; that of the front end reads tokens, not syntax trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq import dims
from strataq.common import table
from strataq.frontend.scriptfacts import DECLARED, DECLARED_MORE, NEXT_NAME
from strataq.operators import changes, coupling, duplication, graph, profile, review, rules
from strataq.operators import declarations as decl
from strataq.config import Config
from strataq.operators.facts import fact, parse_go
from strataq.plans import go_sql
from strataq.sources import tree


def _files(spark: SparkSession, d: str) -> DataFrame:
    return tree.delivered(table(spark, d, "source_files"))


def _go(spark: SparkSession, d: str) -> DataFrame:
    return parse_go(tree.go_sources(_files(spark, d)))


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    """All modules as one tree, so that declarations meet across them."""
    return tree.script_sources(_files(spark, d).withColumn("rel", F.concat_ws("/", "module", "rel")))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """What scripts declare; Go texts have checks of their own."""
    return decl.script_facts(_scripts(spark, d)).where(~F.col("rel").endswith(".go"))


def generated_marker(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", tree.is_generated(F.col("body")).alias("marked"))


def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    return tree.go_sources(_files(spark, d), skip_generated=False).select("module", "rel", "dir")


def go_units(spark: SparkSession, d: str) -> DataFrame:
    return fact(_go(spark, d), "units").drop("dir")


def go_unit_shares(spark: SparkSession, d: str) -> DataFrame:
    units = fact(_go(spark, d), "units").where("has_body").withColumn("language", F.lit("go"))
    return profile.tail_shares(units, "language")


def go_non_unit_lines(spark: SparkSession, d: str) -> DataFrame:
    parsed = _go(spark, d)
    return profile.non_unit_lines(parsed.where("error IS NULL").select("module", "rel", "loc"), fact(parsed, "units"))


def go_dependencies(spark: SparkSession, d: str) -> DataFrame:
    parsed = _go(spark, d)
    return coupling.file_dependencies(parsed, coupling.met_references(parsed))


def go_module_fan_in(spark: SparkSession, d: str) -> DataFrame:
    parsed = _go(spark, d)
    deps = coupling.module_dependencies(coupling.resolved_references(parsed), parsed.select("module", "rel"))
    return coupling.fan_in(deps.withColumn("source", F.concat_ws("/", "module", "source")).withColumn("target", F.concat_ws("/", "module", "target")), "source", "target", "refs")


def go_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.run_rules(_go(spark, d))


def go_size_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.size_rules(_go(spark, d), Config())


def go_comment_findings(spark: SparkSession, d: str) -> DataFrame:
    """Comments that are notices, suppress a warning or speak of unfinished work."""
    return rules.comment_rules(_go(spark, d)).where("rule <> 'COMMENTED_OUT_CODE'")


def go_nested_loops(spark: SparkSession, d: str) -> DataFrame:
    return rules.loop_rules(_go(spark, d), Config()).where("rule = 'NESTED_LOOP'")


def go_branch_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.branch_rules(_go(spark, d))


def go_debug_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.debug_rule(_go(spark, d), Config())


def go_doc_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.doc_rule(_go(spark, d))


def go_literals(spark: SparkSession, d: str) -> DataFrame:
    return fact(_go(spark, d), "literals").drop("dir")


def go_finding_counts(spark: SparkSession, d: str) -> DataFrame:
    return review.counts(go_findings(spark, d))


def go_directory_cycles(spark: SparkSession, d: str) -> DataFrame:
    parsed = _go(spark, d)
    return graph.directory_cycles(graph.import_edges(fact(parsed, "imports"), parsed.select("module", "dir")))


def go_duplication(spark: SparkSession, d: str) -> DataFrame:
    return duplication.module_duplication(fact(_go(spark, d), "lines"), ["module", "rel"])


def comment_only_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each file's last delivery against the one before: modified, and exempt where only comments and layout differ."""
    files = table(spark, d, "source_files").select(F.translate("file_name", "\\", "/").alias("path"), "body", "scanned_at", "file_id")
    w = Window.partitionBy("path").orderBy(F.col("scanned_at").desc_nulls_last(), F.col("file_id").desc())
    ranked = files.withColumn("r", F.row_number().over(w))
    now, before = ranked.where("r = 1").select("path", "body"), ranked.where("r = 2").select("path", "body")
    changed = now.join(before.select("path", F.col("body").alias("old")), "path").where(~F.col("body").eqNullSafe(F.col("old"))).select(F.lit("M").alias("status"), "path")
    return changes.partition_changes(changed, before, now)


def duplicate_exports(spark: SparkSession, d: str) -> DataFrame:
    return decl.export_sites(_typed(spark, d))


def duplicate_values(spark: SparkSession, d: str) -> DataFrame:
    return decl.value_sites(_typed(spark, d))


def duplicate_unions(spark: SparkSession, d: str) -> DataFrame:
    return decl.sites_of_unions(_typed(spark, d))


def union_subsets(spark: SparkSession, d: str) -> DataFrame:
    sets = decl.union_sites(_typed(spark, d)).select("members").distinct().withColumn("key", F.array_join("members", "|"))
    return decl.contained_sets(sets, "key", "members").select("smaller", "larger", F.array_join(F.array_sort("missing"), "|").alias("missing"))


def duplicate_shapes(spark: SparkSession, d: str) -> DataFrame:
    return decl.duplicate_shapes(_typed(spark, d))


def helper_per_package(spark: SparkSession, d: str) -> DataFrame:
    return decl.duplicate_helpers(decl.go_helpers(decl.script_facts(_scripts(spark, d))))


def severity_rank(spark: SparkSession, d: str) -> DataFrame:
    s = _typed(spark, d)
    return decl.ranked(decl.duplicate_exports(s), decl.duplicate_values(s), decl.duplicate_unions(s), decl.union_subsets(s), decl.duplicate_shapes(s), decl.duplicate_helpers(decl.go_helpers(decl.script_facts(_scripts(spark, d)))))


QUERIES = {
    f.__name__: f
    for f in (
        generated_marker, scanned_files, go_units, go_unit_shares, go_non_unit_lines, go_dependencies, go_module_fan_in, go_findings, go_size_findings, go_comment_findings, go_nested_loops, go_branch_findings, go_debug_findings, go_doc_findings, go_literals, go_finding_counts, go_directory_cycles, go_duplication, comment_only_changes,
        duplicate_exports, duplicate_values, duplicate_unions, union_subsets, duplicate_shapes, helper_per_package, severity_rank,
    )
}

_FILES_SQL = """
w AS (SELECT *, replace(file_name, '\\', '/') AS n, coalesce(replace(module_path, '\\', '/'), '') AS module FROM source_files),
v AS (SELECT *, CASE WHEN module <> '' AND starts_with(n, module || '/') THEN substr(n, length(module) + 2) ELSE n END AS rel FROM w),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module, rel ORDER BY scanned_at DESC NULLS LAST, file_id DESC) AS rr FROM v) WHERE rr = 1)
"""
_SCRIPTS_SQL = (
    _FILES_SQL
    + """,
k AS (SELECT CASE WHEN module = '' THEN '/' || rel ELSE module || '/' || rel END AS rel, coalesce(CASE WHEN ends_with(rel, '.vue') THEN array_to_string(regexp_extract_all(body, '(?s)<script[^>]*>(.*?)</script>', 1), chr(10)) ELSE body END, '') AS raw
      FROM f WHERE regexp_matches(rel, '\\.[cm]?tsx?$|\\.vue$|\\.go$')),
s AS (SELECT rel, regexp_replace(regexp_replace(raw, '(?s)/\\*.*?\\*/', '', 'g'), '(?m)(^|[^:"''`\\\\])//[^\r\n]*', '\\1', 'g') AS text FROM k
      WHERE NOT ends_with(rel, '.go') AND NOT regexp_matches(rel, '\\.(test|spec)\\.([cm]?tsx?|vue)$|__tests__|_test\\.go$') AND NOT regexp_matches('/' || rel, '/(%s)/'))
"""
    % "|".join(d.replace(".", "\\.") for d in dims.SKIP_DIRS)
)
_CONSTANT_SQL = r"(?m)^[ \t]*(?:export[ \t]+)?const[ \t]+[A-Za-z_$][\w$]*(?:\s*:\s*[^=]+)?\s*=\s*(?:''(?:[^''\\]|\\.)*''|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`)"
_MEMBER_SQL = "(?:''[^'']+''|\"[^\"]+\")"
_UNIONS_SQL = rf"""
h AS (SELECT rel, unnest(regexp_extract_all(text, '(?:type\s+[A-Za-z_$][\w$]*\s*=|[A-Za-z_$][\w$]*\s*\??\s*:)\s*{_MEMBER_SQL}(?:\s*\|\s*{_MEMBER_SQL}){{2,}}')) AS hit FROM s),
t AS (SELECT rel, hit, list_sort(list_transform(regexp_extract_all(regexp_replace(hit, '^[^''"]*', ''), '{_MEMBER_SQL}'), lambda x: substr(x, 2, length(x) - 2))) AS m FROM h),
u AS (SELECT rel AS file, regexp_extract(hit, '^(?:type\s+)?([A-Za-z_$][\w$]*)', 1) AS name, m, array_to_string(m, '|') AS members FROM t)
"""
_OUT = "|".join(x.replace(".", chr(92) + ".") for x in dims.EXCLUDE_DIRS)
_MARKED = "(?m)\\A(?:[ \\t\\r]*(?://[^\\n]*|/\\*[^\\n]*)?\\n)*// Code generated [^\\n]* DO NOT EDIT\\.\\r?$"
_GO_SQL = f"""WITH {_FILES_SQL},
g AS (SELECT module, rel, CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END AS dir, body FROM f
      WHERE ends_with(rel, '.go') AND NOT ends_with(rel, '_test.go') AND NOT regexp_matches(rel, '(^|/)\\.[^/]*/') AND NOT regexp_matches(rel, '^({_OUT})(/|$)') AND NOT regexp_matches(coalesce(body, ''), '{_MARKED}')),
{go_sql.TOKENS}, {go_sql.UNITS}, {go_sql.DECLS}"""


def _ascii_words(pattern: str) -> str:
    """A pattern of dims in RE2, which has no look-arounds; its \\b is of ASCII words too."""
    return pattern.replace("(?<![0-9A-Za-z_])", r"\b").replace("(?![0-9A-Za-z_])", r"\b").replace("'", "''")


SQL = {
    "go_units": f"{_GO_SQL} {go_sql.UNIT_ROWS}",
    "go_unit_shares": f"{_GO_SQL}, a AS (SELECT 'go' AS language, * FROM units WHERE has_body) {go_sql.tail_rows(dims.UNIT_PROPERTIES, dims.AT_CAP_MARGIN)}",
    "go_non_unit_lines": f"{_GO_SQL} SELECT t.module, t.rel, CAST(greatest(t.loc - coalesce(u.loc, 0), 0) AS BIGINT) AS non_unit_loc FROM (SELECT module, rel, count(DISTINCT line) AS loc FROM tok WHERE NOT remark AND NOT nl GROUP BY 1, 2) t LEFT JOIN (SELECT module, rel, sum(loc) AS loc FROM units WHERE has_body GROUP BY 1, 2) u USING (module, rel)",
    "go_dependencies": f"{_GO_SQL}, {go_sql.DEPENDENCIES} {go_sql.DEPENDENCY_ROWS}",
    "go_module_fan_in": f"{_GO_SQL}, {go_sql.DEPENDENCIES} {go_sql.FAN_IN_ROWS}",
    "go_size_findings": f"{_GO_SQL} {go_sql.size_findings(dims.BANDS)}",
    "go_comment_findings": f"{_GO_SQL} {go_sql.comment_findings(*(_ascii_words(p) for p in (dims.NOTICE, dims.UNFINISHED, dims.SUPPRESSION)))}",
    "go_nested_loops": f"{_GO_SQL}, {go_sql.NESTED_LOOPS} SELECT * FROM nested",
    "go_branch_findings": f"{_GO_SQL}, {go_sql.BRANCHES} SELECT * FROM empty_branch UNION ALL SELECT * FROM bare_switch",
    "go_debug_findings": f"{_GO_SQL}, {go_sql.DEBUG} {go_sql.DEBUG_ROWS}",
    "go_doc_findings": f"{_GO_SQL} {go_sql.DOC_ROWS}",
    "go_literals": f"{_GO_SQL} {go_sql.LITERAL_ROWS}",
    "go_duplication": f"{_GO_SQL}, {go_sql.DUPLICATION_ROWS}",
    "generated_marker": """
WITH l AS (SELECT file_id, list_transform(string_split(coalesce(body, ''), chr(10)), lambda x: regexp_replace(x, '\\r+$', '')) AS ls FROM source_files),
c AS (SELECT file_id, ls, list_position(list_transform(ls, lambda x: NOT (regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g') = '' OR regexp_matches(x, '^[ \\t]*(//|/\\*)'))), true) AS p FROM l)
SELECT file_id, len(list_filter(CASE WHEN p > 0 THEN list_slice(ls, 1, p - 1) ELSE ls END, lambda x: regexp_matches(x, '^// Code generated .* DO NOT EDIT\\.$'))) > 0 AS marked FROM c""",
    "scanned_files": f"WITH {_FILES_SQL} SELECT module, rel, CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END AS dir FROM f WHERE ends_with(rel, '.go') AND NOT ends_with(rel, '_test.go') AND NOT regexp_matches(rel, '(^|/)\\.[^/]*/') AND NOT regexp_matches(rel, '^({'|'.join(d.replace('.', chr(92) + '.') for d in dims.EXCLUDE_DIRS)})(/|$)')",
    "duplicate_exports": f"WITH {_SCRIPTS_SQL}, x AS (SELECT DISTINCT rel, unnest(list_concat(regexp_extract_all(text, '{DECLARED}', 1), flatten(list_transform(regexp_extract_all(text, '{DECLARED_MORE}', 1), lambda y: regexp_extract_all(y, '{NEXT_NAME}', 1))))) AS name FROM s) SELECT name, rel AS file FROM x WHERE name IN (SELECT name FROM x GROUP BY name HAVING count(*) > 1)",
    "duplicate_values": f"""WITH {_SCRIPTS_SQL}, h AS (SELECT rel, unnest(regexp_extract_all(text, '{_CONSTANT_SQL}')) AS hit FROM s),
c AS (SELECT rel AS file, regexp_extract(hit, 'const[ \\t]+([A-Za-z_$][\\w$]*)', 1) AS name, regexp_extract(hit, '(?s)^[^=]*=\\s*(.)(.*).$', 1) AS quote, regexp_extract(hit, '(?s)^[^=]*=\\s*(.)(.*).$', 2) AS value FROM h),
long AS (SELECT * FROM c WHERE length(value) >= {dims.MIN_VALUE_LENGTH} AND NOT (quote = '`' AND contains(value, '${{')))
SELECT value, file, name FROM long WHERE value IN (SELECT value FROM long GROUP BY value HAVING count(*) > 1 AND (count(DISTINCT name) > 1 OR count(DISTINCT file) > 1))""",
    "duplicate_unions": f"""WITH {_SCRIPTS_SQL}, {_UNIONS_SQL} SELECT members, file, name FROM u WHERE members IN (SELECT members FROM u GROUP BY members HAVING count(*) > 1)""",
    "union_subsets": f"""WITH {_SCRIPTS_SQL}, {_UNIONS_SQL}, g AS (SELECT DISTINCT members, list_distinct(m) AS m FROM u)
SELECT a.members AS smaller, b.members AS larger, array_to_string(list_sort(list_filter(b.m, lambda x: NOT list_contains(a.m, x))), '|') AS missing FROM g a JOIN g b ON len(a.m) < len(b.m) AND list_has_all(b.m, a.m)""",
}
