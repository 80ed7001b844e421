"""LETOR text lines: ``rel qid:Q fid:val ... # comment``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.running import running_sums
from .groups import write_splits


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds rel, qid and sparse (map of feature id to value). Lines of fewer than two tokens are dropped; a token that
    starts with # ends a line; tokens without a colon are passed over; a repeated feature id takes its last value."""
    tokens = lines.withColumn("__t", F.expr(f"filter(split(trim(`{line}`), r'\\s+'), x -> x <> '')")).where(F.size("__t") >= 2)
    comment = "array_position(transform(__t, x -> startswith(x, '#')), true)"
    rest = f"filter(slice(__t, 3, greatest(0, if({comment} > 0, cast({comment} as int) - 1, size(__t)) - 2)), x -> contains(x, ':'))"
    pairs = tokens.withColumn("__p", F.expr(f"transform({rest}, x -> struct(cast(substring_index(x, ':', 1) as int) as k, cast(substring_index(x, ':', -1) as double) as v))"))
    last = "map_from_entries(filter(__p, (x, i) -> not exists(slice(__p, i + 2, size(__p)), y -> y.k = x.k)))"
    return pairs.select(
        *lines.columns, F.expr("cast(__t[0] as int)").alias("rel"), F.expr("substring_index(__t[1], ':', -1)").alias("qid"), F.expr(last).alias("sparse")
    )


def dense(rows: DataFrame, n_features: int = 700) -> DataFrame:
    """Adds features: ids from 1, others dropped, missing ones 0."""
    return rows.withColumn("features", F.expr(f"transform(sequence(1, {n_features}), i -> coalesce(try_element_at(sparse, i), 0D))"))


def islands(rows: DataFrame, order: str = "line_no", partition: tuple[str, ...] = (), size: int = 100_000, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds island: lines of one query that follow each other; a query that comes back starts another island.

    ``order``: a whole number; lines that share one stand in the order of the columns ``ties`` and then of their qids, and are
    all in the island that the last of them is in. ``partition``: e.g. the file; consecutive lines are those of one
    partition. Lines are cut into blocks of ``size`` numbers; a block's first line is held against the last one of the
    block before, and islands are numbered by running sums over blocks, so no window spans a file.
    """
    blocked = rows.withColumn("__block", F.floor(F.col(order) / size))
    ends = blocked.groupBy(*partition, "__block").agg(F.max_by(F.struct("qid"), F.struct(order, *ties, "qid")).alias("__last"))
    by_block = Window.partitionBy(*partition).orderBy("__block")
    before = ends.select(*partition, "__block", F.lag("__last").over(by_block).alias("__before"))
    by_line = Window.partitionBy(*partition, "__block").orderBy(order, *ties, "qid")
    joined = blocked.join(before, [*partition, "__block"]).withColumn("__previous", F.coalesce(F.lag(F.struct("qid")).over(by_line), F.col("__before")))
    same = F.col("__previous").isNotNull() & F.col("qid").eqNullSafe(F.col("__previous.qid"))
    marked = joined.withColumn("__new", F.when(same, 0).otherwise(1)).drop("__block", "__before", "__previous")
    return running_sums(marked, order, {"island": "__new"}, partition, size).withColumn("island", F.col("island").cast("long")).drop("__new")


def grouped(rows: DataFrame, order: str = "line_no", partition: tuple[str, ...] = ()) -> DataFrame:
    """Nested groups (query_id, features, relevance) of consecutive lines."""
    marked = islands(rows, order, partition)
    group = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "rel", "features")))
    return marked.groupBy(*partition, "island", "qid").agg(group.alias("g")).select(
        *partition, F.col("qid").alias("query_id"), F.expr("transform(g, x -> transform(x.features, v -> cast(v as float)))").alias("features"), F.expr("transform(g, x -> cast(x.rel as tinyint))").alias("relevance")
    )


def converted(spark: SparkSession, raw_dir: str, out_dir: str, n_features: int = 700, chunk: int = 10_000) -> dict[str, int]:
    """Converts ``<set>.<split>.txt`` files to ``<out>/<set>/<split>`` and returns the groups of each split.

    Lines are numbered in the order of each file; a file is one partition of the numbering.
    """
    text = spark.read.option("wholetext", False).text(f"{raw_dir}/*.txt").select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Blocks of a file are read in order of their numbers, and lines in a block in theirs; files of 2 ** 53 bytes are enough.
    text = text.withColumn("__id", F.monotonically_increasing_id())
    firsts = text.groupBy("file", "block").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = firsts.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    numbered = text.join(starts, ["file", "block"]).withColumn("line_no", F.col("start") + F.col("__id") - F.col("first")).drop("start", "first")
    groups = grouped(dense(parsed(numbered), n_features), "line_no", ("file",))
    name = F.split("file", r"\.")
    split = F.when(F.size(name) > 2, name[1]).otherwise(F.lit("train"))
    return write_splits(groups.withColumn("set", name[0]).withColumn("split", split), out_dir, chunk)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Converts LETOR text files to chunked Parquet")
    parser.add_argument("--raw-dir", required=True)
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--num-features", type=int, default=700)
    parser.add_argument("--chunk-size", type=int, default=10_000)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("rankloom").getOrCreate()
    for split, count in sorted(converted(spark, given.raw_dir, given.output_dir, given.num_features, given.chunk_size).items()):
        print(f"{split}: {count} queries")


if __name__ == "__main__":
    main()
