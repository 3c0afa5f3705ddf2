"""The nineteen rules over fact tables, as one findings relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq import dims
from strataq.config import Config
from strataq.functions.text import hardcoded_url, is_filesystem_path, trim_comment
from strataq.operators.coupling import file_dependencies, met_references
from strataq.operators.facts import fact
from strataq.operators.graph import directory_cycles, import_edges
from strataq.sources.tree import base_name, under

FINDING = ["module", "rule", "element", "description", "file", "line", "severity", "value"]


def severity(value: Column, band: tuple[int, int]) -> Column:
    """Both bounds are outside the band below them."""
    return F.when(value > band[1], "very high risk").when(value > band[0], "high risk").otherwise("none")


def describe(value: Column, band: tuple[int, int]) -> Column:
    high, very = band
    return F.when(value > very, f"(very high risk, [> {very}])").when(value > high, f"(high risk, [{high + 1} - {very}])").otherwise("")


def banded(rows: DataFrame, rule: str, column: str, unit: str, band: tuple[int, int]) -> DataFrame:
    """Findings of a threshold rule over (module, element, file, line, column); a null value is not measured and finds nothing."""
    v = F.col(column)
    return rows.where(v > min(band)).select("module", F.lit(rule).alias("rule"), "element", F.concat(F.lit(f"{unit}: "), v.cast("string"), F.lit(" "), describe(v, band)).alias("description"), "file", "line", severity(v, band).alias("severity"), v.cast("long").alias("value"))


def _plain(rows: DataFrame, rule: str, description: Column) -> DataFrame:
    return rows.select("module", F.lit(rule).alias("rule"), F.coalesce("element", base_name(F.col("rel"))).alias("element"), description.alias("description"), F.col("rel").alias("file"), "line", F.lit("finding").alias("severity"), F.lit(0).cast("long").alias("value"))


def size_rules(parsed: DataFrame, cfg: Config) -> DataFrame:
    units = fact(parsed, "units").withColumnRenamed("rel", "file")
    return reduce(
        DataFrame.unionByName,
        [
            banded(units, "FUNCTION_SIZE_RISK", "tokens", "function size in tokens", cfg.bands["FUNCTION_SIZE_RISK"]),
            banded(units, "PARAMETER_RISK", "params", "parameters", cfg.bands["PARAMETER_RISK"]),
            banded(units, "FUNCTION_COMPLEXITY_RISK", "complexity", "cognitive complexity", cfg.bands["FUNCTION_COMPLEXITY_RISK"]),
        ],
    )


def dependency_rules(parsed: DataFrame, cfg: Config) -> DataFrame:
    deps = file_dependencies(parsed, met_references(parsed), cfg.span_granularity).withColumn("element", base_name(F.col("rel"))).withColumnRenamed("rel", "file")
    return banded(deps, "DEPENDENCY_VOLUME_RISK", "volume", "dependency volume", cfg.bands["DEPENDENCY_VOLUME_RISK"]).unionByName(banded(deps, "DEPENDENCY_SPAN_RISK", "span", "dependency span", cfg.bands["DEPENDENCY_SPAN_RISK"]))


def cycle_rule(parsed: DataFrame) -> DataFrame:
    cycles = directory_cycles(import_edges(fact(parsed, "imports"), parsed.select("module", "dir")))
    n = F.size("members")
    return cycles.select(
        "module", F.lit("CYCLIC_REFERENCE").alias("rule"), base_name(F.col("to_dir")).alias("element"),
        F.concat(F.lit("import is part of a "), n.cast("string"), F.lit("-directory reference cycle: "), F.array_join("members", " <-> ")).alias("description"),
        F.col("rel").alias("file"), "line", F.lit("finding").alias("severity"), n.cast("long").alias("value"),
    )


def literal_rules(parsed: DataFrame, cfg: Config) -> DataFrame:
    literals = fact(parsed, "literals")
    url = literals.withColumn("url", hardcoded_url(F.col("value"), cfg.url_allowlist_hosts)).where("url IS NOT NULL")
    return _plain(url, "HARDCODED_URL", F.col("url")).unionByName(_plain(literals.where(is_filesystem_path(F.col("value"))), "HARDCODED_PATH", F.col("value")))


def comment_rules(parsed: DataFrame) -> DataFrame:
    comments = fact(parsed, "comments")
    text = F.col("text")
    return reduce(
        DataFrame.unionByName,
        [
            _plain(comments.where(text.rlike(dims.NOTICE)), "COPYRIGHT_OR_LICENSE_NOTICE", trim_comment(text)),
            _plain(comments.where(text.rlike(dims.UNFINISHED)), "UNFINISHED_WORK", trim_comment(text)),
            _plain(comments.where(text.rlike(dims.SUPPRESSION)), "SUPPRESSED_WARNING", F.concat(F.lit("lint suppression: "), trim_comment(text))),
            _plain(comments.where(F.col("block_code").isNotNull()), "COMMENTED_OUT_CODE", F.concat(F.lit("commented-out code: "), F.col("block_code"))),
            _plain(comments.where("code"), "COMMENTED_OUT_CODE", F.concat(F.lit("commented-out code: "), trim_comment(text))),
        ],
    )


def loop_rules(parsed: DataFrame, cfg: Config) -> DataFrame:
    nested = fact(parsed, "loops").where("depth >= 1")
    calls = fact(parsed, "loop_calls").where(~F.array_contains("cursors", F.col("root")) | (F.col("root") == ""))
    method, root = F.col("method"), F.col("root")
    suffixed = reduce(lambda a, b: a | b, [method.endswith(s) & (method != s) for s in cfg.sql_method_suffixes if s], F.lit(False))
    why = F.when(method.isin(cfg.sql_methods), "database call").when(suffixed, "transaction-scoped repository call").when(root.isin(cfg.sql_receivers), "database call")
    first = Window.partitionBy("module", "rel", "element", "line").orderBy("seq")
    sql = calls.where(~method.isin(cfg.sql_chain_methods)).withColumn("why", why).where("why IS NOT NULL").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    concat = fact(parsed, "loop_concats").where("known_string")
    return reduce(
        DataFrame.unionByName,
        [
            _plain(sql, "SQL_IN_LOOP", F.concat("why", F.lit(" "), "method", F.lit("() inside a loop; one round trip per iteration"))),
            _plain(concat, "STRING_CONCAT_IN_LOOP", F.concat(F.lit("string "), "target", F.lit(" rebuilt by concatenation inside a loop; use strings.Builder"))),
            _plain(nested, "NESTED_LOOP", F.concat(F.lit("loop nested "), (F.col("depth") + 1).cast("string"), F.lit(" deep; the work inside runs the product of both counts"))),
        ],
    )


def branch_rules(parsed: DataFrame) -> DataFrame:
    empty = fact(parsed, "branches").where("empty AND NOT has_else")
    bare = fact(parsed, "switches").where("NOT has_default AND NOT commented_arm AND tag IN ('value', 'type')")
    return _plain(empty, "EMPTY_BRANCH", F.lit("if statement with an empty body and no else; the condition is tested and then ignored")).unionByName(
        _plain(bare, "SWITCH_WITHOUT_DEFAULT", F.concat("kind", F.lit(" has no default clause; an unhandled value passes through silently")))
    )


def debug_rule(parsed: DataFrame, cfg: Config) -> DataFrame:
    calls = fact(parsed, "calls").where(~under(F.col("rel"), cfg.debug_statement_exclude_dirs))
    std = fact(parsed, "imports").where("local_name = 'log' AND path = 'log'").select("module", "rel", F.lit(True).alias("std")).distinct()
    pkg, name = F.col("pkg"), F.col("name")
    says = (
        F.when(pkg.isNull() & name.isin("print", "println"), F.concat(F.lit("builtin "), name, F.lit("() writes to stderr and is not a logger")))
        .when((pkg == "fmt") & name.startswith("Print"), F.concat(F.lit("fmt."), name, F.lit("() writes to stdout instead of the logger")))
        .when((pkg == "log") & F.col("std"), F.concat(F.lit("standard log."), name, F.lit("() bypasses the structured slog logger")))
    )
    return _plain(calls.join(std, ["module", "rel"], "left").withColumn("says", says).where("says IS NOT NULL"), "DEBUG_STATEMENT", F.col("says"))


def doc_rule(parsed: DataFrame) -> DataFrame:
    bare = fact(parsed, "exported").where("NOT documented AND receiver_exported")
    word = F.col("word")
    function = word.isin("function", "method")
    says = F.when(function, F.concat(F.lit("exported "), word, F.lit(" has no doc comment"))).otherwise(F.concat(F.lit("exported "), word, F.lit(" "), "name", F.lit(" in "), base_name(F.col("rel")), F.lit(" has no doc comment")))
    return _plain(bare, "MISSING_DOC_COMMENT", says)


def run_rules(parsed: DataFrame, cfg: Config | None = None, cycles: bool = True) -> DataFrame:
    """FINDING columns of all rules that are not disabled."""
    cfg = cfg or Config()
    parts = [size_rules(parsed, cfg), dependency_rules(parsed, cfg), literal_rules(parsed, cfg), comment_rules(parsed), loop_rules(parsed, cfg), branch_rules(parsed), debug_rule(parsed, cfg), doc_rule(parsed)]
    if cycles:
        parts.append(cycle_rule(parsed))
    out = reduce(DataFrame.unionByName, parts).select(*FINDING)
    return out.where(~F.col("rule").isin(cfg.disabled_rules)) if cfg.disabled_rules else out
