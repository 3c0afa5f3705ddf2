"""Source files: from a directory tree or a delivered table, pruned and routed."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq import dims
from strataq.common import tasks
from strataq.functions.text import any_of


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(rel, body) of all files below root, one row a file; roots that are missing give none."""
    if "://" not in root and not os.path.isdir(root):
        return spark.createDataFrame([], "rel string, body string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = os.path.abspath(root) if "://" not in root else root
    rel = F.regexp_replace(F.col("path"), r"^(?:file:)?/*", "/")
    return files.select(F.substring(rel, F.lit(len(base) + 2), F.length(rel)).alias("rel"), F.decode("content", "UTF-8").alias("body"))


def module_path(go_mod: str) -> str:
    """The module line of a go.mod text."""
    import re

    m = re.search(r"^module\s+(\S+)", go_mod, re.M)
    if m is None:
        raise ValueError("no module line")
    return m.group(1).strip('"')


def delivered(files: DataFrame) -> DataFrame:
    """(file_id, module, rel, dir, code_language, body): each file of a module once, as last scanned.

    Separators are made one; a file below no module keeps its name. Null bodies
    stay; of deliveries at one moment the one with the greatest id holds. Ids are unique.
    """
    name = F.coalesce(F.translate("file_name", "\\", "/"), F.lit(""))
    module = F.coalesce(F.translate("module_path", "\\", "/"), F.lit(""))
    rel = F.when((module != "") & name.startswith(F.concat(module, F.lit("/"))), F.substring(name, F.length(module) + 2, F.length(name))).otherwise(name)
    rows = files.select("file_id", module.alias("module"), rel.alias("rel"), "code_language", "body", "scanned_at")
    # which delivery holds is settled without the texts, by maxima before the shuffle; the texts then move once, by a
    # key that no file repeats, and lie spread for the parser
    last = rows.groupBy("module", "rel").agg(F.max(F.struct("scanned_at", "file_id")).alias("_l")).select("module", "rel", F.col("_l.file_id").alias("file_id"))
    keys = ["module", "rel", "file_id"]
    once = rows.repartition(tasks(files.sparkSession), *keys).join(last, keys, "left_semi")
    return once.select("file_id", "module", "rel", directory(F.col("rel")).alias("dir"), "code_language", "body")


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def under(path: Column, dirs: list[str]) -> Column:
    """Whether a path lies below one of the root-anchored directories."""
    return any_of([(path == d.strip("/")) | path.startswith(d.strip("/") + "/") for d in dirs if d.strip("/")])


def go_sources(files: DataFrame, exclude_dirs: list[str] = dims.EXCLUDE_DIRS, include_tests: bool = False, skip_generated: bool = True) -> DataFrame:
    """The Go files to scan: no hidden or excluded directories, no tests, nothing generated, unless asked for.
    The generated test reads the text, not the parse, and comes before the front end."""
    kept = files.where(F.col("rel").endswith(".go") & ~F.col("rel").rlike(r"(^|/)\.[^/]*/") & ~under(F.col("rel"), exclude_dirs))
    if not include_tests:
        kept = kept.where(~F.col("rel").endswith("_test.go"))
    return kept.where(~is_generated(F.col("body"))) if skip_generated else kept


def is_generated(body: Column) -> Column:
    """The marker line, before the first line that is neither blank nor starts a comment."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"\r+$", ""))
    trimmed = F.transform(lines, lambda x: F.trim(F.translate(x, "\t", " ")))
    code = F.array_position(F.transform(trimmed, lambda x: ~((x == "") | x.startswith("//") | x.startswith("/*"))), F.lit(True))
    head = F.when(code > 0, F.slice(lines, F.lit(1), (code - 1).cast("int"))).otherwise(lines)
    # the marker's fixed words are sought first: most texts are settled without being cut into lines
    return F.coalesce(body.contains(dims.GENERATED_WORDS), F.lit(False)) & F.exists(head, lambda x: x.rlike(dims.GENERATED_MARKER))


def script_sources(files: DataFrame, skip_paths: list[str] | None = None) -> DataFrame:
    """Files of the declaration scan: TypeScript, Vue and Go, no tests, no built or vendored trees; text is what declares."""
    rel = F.col("rel")
    kept = files.where(rel.rlike(r"\.[cm]?tsx?$|\.vue$|\.go$"))
    kept = kept.where(~(rel.rlike(r"\.(test|spec)\.(?:[cm]?tsx?|vue)$") | rel.contains("__tests__") | rel.endswith("_test.go")))
    kept = kept.where(~any_of([F.concat(F.lit("/"), rel).contains(f"/{d}/") for d in dims.SKIP_DIRS]))
    if skip_paths:
        kept = kept.where(~rel.rlike("|".join(f"(?:{p})" for p in skip_paths)))
    text = F.when(rel.endswith(".vue"), vue_script(F.col("body"))).otherwise(F.col("body"))
    return kept.withColumn("text", strip_comments(F.coalesce(text, F.lit(""))))


def vue_script(body: Column) -> Column:
    """All script blocks of a component, joined."""
    return F.array_join(F.regexp_extract_all(body, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), "\n")


def strip_comments(text: Column) -> Column:
    """Without block comments, then without // comments that do not follow a quote, colon or backslash."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:\"'`\\])//.*$", "$1")
