"""New source files as a stream; the fact tables of each micro-batch are those of a scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataq.common import drop_stash
from strataq.operators.facts import parse_go
from strataq.sources.tree import directory, go_sources


def watch_tree(spark: SparkSession, root: str, module: str) -> DataFrame:
    """(module, rel, dir, body) of files as they appear below root."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(F.lit(module).alias("module"), rel.alias("rel"), F.decode("content", "UTF-8").alias("body")).withColumn("dir", directory(F.col("rel")))


def each_batch(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Parses each batch's Go files once and hands the facts on, which are removed when the sink is done; offsets and files seen are kept under checkpoint."""

    def run(batch: DataFrame, n: int) -> None:
        facts = parse_go(go_sources(batch))
        sink(facts, n)
        drop_stash(facts)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
