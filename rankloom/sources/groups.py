"""Query groups: nested on disk, one row a document in plans; readers, writers and orders of replay."""

from __future__ import annotations

import math
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import uniform

REQUIRED = ("query_id", "features", "relevance")
#: Relevance grades of event types (fixed values).
GRADES = {"purchase": 4, "signup": 3, "click": 2, "view": 1, "error": 0}


def events_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, week, user_id, doc, rel, features): a user's events of a week are a query group.

    features = [value, k, doc, hour]; documents are numbered from 0 by event.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value", "props")
    week = F.date_trunc("week", "ts")
    rel = F.lit(0)
    for kind, grade in GRADES.items():
        rel = F.when(F.col("event_type") == kind, F.lit(grade)).otherwise(rel)
    doc = F.row_number().over(Window.partitionBy("user_id", "week").orderBy("event_id")) - 1
    rows = events.withColumn("week", week).withColumn("doc", doc.cast("int"))
    features = F.array(F.col("value"), F.regexp_extract("props", "[0-9]+", 0).cast("double"), F.col("doc").cast("double"), F.hour("ts").cast("double"))
    query_id = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("week", "yyyyMMdd"))
    return rows.select(query_id.alias("query_id"), "week", "user_id", "doc", rel.alias("rel"), features.alias("features"))


def embeddings_as_documents(spark: SparkSession, sf_dir: str, group: int = 25) -> DataFrame:
    """(query_id, doc, rel, features): wide feature vectors, ``group`` documents a query."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(
        F.expr(f"cast(vec_id div {group} as string)").alias("query_id"), (F.col("vec_id") % group).cast("int").alias("doc"), (F.col("label") % 5).cast("int").alias("rel"), F.col("embedding").cast("array<double>").alias("features")
    )


def nested(docs: DataFrame) -> DataFrame:
    """(query_id, features, relevance), arrays in document order."""
    group = F.array_sort(F.collect_list(F.struct("doc", "rel", "features")))
    return docs.groupBy("query_id").agg(group.alias("g")).select(
        "query_id", F.expr("transform(g, x -> transform(x.features, v -> cast(v as float)))").alias("features"), F.expr("transform(g, x -> cast(x.rel as tinyint))").alias("relevance")
    )


def flat(groups: DataFrame, *keep: str) -> DataFrame:
    """(query_id, doc, rel, features) of nested groups, after the columns to keep."""
    both = groups.select(*keep, "query_id", F.posexplode(F.arrays_zip("relevance", "features")).alias("doc", "x"))
    return both.select(*keep, "query_id", "doc", F.col("x.relevance").cast("int").alias("rel"), F.col("x.features").alias("features"))


def checked(groups: DataFrame, *keep: str) -> DataFrame:
    missing = [c for c in REQUIRED if c not in groups.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return groups.select(*keep, "query_id", F.col("features").cast("array<array<float>>").alias("features"), F.col("relevance").cast("array<tinyint>").alias("relevance"))


def chunk_files(spark: SparkSession, folder: str, limit: int | None = None) -> list[str]:
    """Sorted chunk files of a split, wherever the folder is; none if it does not exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(path, "chunk_*.parquet"))
    return sorted(f.getPath().toString() for f in found or [])[:limit]


def read_groups(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Nested groups of the chunks under ``folder``, with required columns checked and cast."""
    files = chunk_files(spark, folder, limit)
    if not files:
        return spark.createDataFrame([], "query_id string, features array<array<float>>, relevance array<tinyint>")
    return checked(spark.read.parquet(*files))


def write_groups(groups: DataFrame, folder: str, chunk: int = 10_000) -> None:
    """Snappy Parquet files ``chunk_0000.parquet`` and so on, of at most ``chunk`` groups, in place of what was there."""
    above, _, split = folder.rstrip("/").rpartition("/")
    top, _, own = above.rpartition("/")
    write_splits(groups.withColumn("set", F.lit(own)).withColumn("split", F.lit(split)), top, chunk)


def write_splits(groups: DataFrame, folder: str, chunk: int = 10_000) -> dict[str, int]:
    """Groups of all sets and splits (columns ``set`` and ``split``) to ``<folder>/<set>/<split>/chunk_0000.parquet`` and so
    on, of at most ``chunk`` groups a file; returns how many each split got.

    One job writes them all beside the folders, which are then exchanged: a write that is killed leaves the old chunks as
    they were. Splits that the groups don't name stay as they are.
    """
    spark = groups.sparkSession
    jvm, token = spark.sparkContext._jvm, uuid.uuid4().hex
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    files = at(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    staging = f"{folder.rstrip('/')}/_staging-{token}"
    rows = checked(groups, "set", "split")
    rows.write.partitionBy("set", "split").option("compression", "snappy").option("maxRecordsPerFile", chunk).parquet(staging)
    found = spark.read.schema(rows.schema).parquet(staging).groupBy("set", "split").count().collect()
    inside = lambda path: sorted((f.getPath() for f in files.listStatus(path) or []), key=lambda p: p.getName())
    value = lambda path: unquote(path.getName().partition("=")[2])
    for own in (p for p in inside(at(staging)) if p.getName().startswith("set=")):
        files.mkdirs(at(folder, value(own)))
        for new in inside(own):
            for i, path in enumerate(p for p in inside(new) if p.getName().endswith(".parquet")):
                files.rename(path, jvm.org.apache.hadoop.fs.Path(new, f"chunk_{i:04d}.parquet"))
            target, old = at(folder, value(own), value(new)), at(folder, value(own), f"_old-{token}")
            if files.exists(target):
                files.rename(target, old)
            files.rename(new, target)
            files.delete(old, True)
    files.delete(at(staging), True)
    return {f"{r['set']}/{r['split']}": r["count"] for r in found}


#: Queries of a range that one task numbers, about; ranges at most; sampled keys for each range.
RANGE_QUERIES, MOST_RANGES, RANGE_SAMPLE = 50_000, 4_096, 16


def numbered(rows: DataFrame, *order: str, size: int | None = None) -> DataFrame:
    """Adds ``place``, from 1, in the order of columns that tell rows apart (numbers, strings, dates; no nulls).

    Rows are dealt to ranges of the order between split points, the quantiles of a bounded sample that is drawn by hash; each
    range is numbered alone and offset by the counts of those before. There are as many ranges as the number of rows asks
    for, one where they are few, so no window spans more rows than a range. Split points are constants of the plan, so
    lost tasks deal their rows as before.
    """
    size = size or RANGE_QUERIES
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, -(-n // size)))
    place = F.row_number()
    if ranges == 1:
        return rows.withColumn("place", place.over(Window.orderBy(*order)).cast("long"))
    sample = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(ranges * RANGE_SAMPLE)
    keys = [tuple(r) for r in sample.orderBy(*order).collect()]
    points = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})
    kinds = rows.select(*order).schema
    splits = rows.sparkSession.createDataFrame([(points,)], T.StructType([T.StructField("__splits", T.ArrayType(kinds))]))
    # One row of at most MOST_RANGES keys. The range of a row is the number of split points that aren't above it.
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    dealt = rows.withColumn("__key", key).crossJoin(F.broadcast(splits)).withColumn("__range", F.expr(_BISECT.format(steps=max(1, math.ceil(math.log2(len(points) + 1)))))).drop("__splits", "__key")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inner = place.over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__inner", inner).join(F.broadcast(offsets), "__range").withColumn("place", F.col("__inner") + F.col("__offset")).select(*rows.columns, "place")


#: The number of elements of __splits (ascending) that aren't above __key, by halving.
_BISECT = (
    "aggregate(sequence(1, {steps}), named_struct('low', 0, 'high', size(__splits)), (a, i) -> if(a.low >= a.high, a, "
    "if(__splits[(a.low + a.high) div 2] <= __key, named_struct('low', cast((a.low + a.high) div 2 + 1 as int), 'high', a.high), "
    "named_struct('low', a.low, 'high', cast((a.low + a.high) div 2 as int)))), a -> a.low)"
)


def query_order(docs: DataFrame) -> DataFrame:
    """(query_id, week, round, n): rounds from 1 in the order of (week, user_id), which is one order over all queries."""
    queries = docs.groupBy("week", "user_id", "query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return numbered(queries, "week", "user_id").select("query_id", "week", F.col("place").cast("int").alias("round"), "n")


def cycled(spark: SparkSession, order: DataFrame, n_rounds: int) -> DataFrame:
    """(t, query_id): round t replays query t mod n."""
    n = order.count()
    if n == 0:
        return spark.createDataFrame([], "t long, query_id string")
    rounds = spark.range(n_rounds).select(F.col("id").alias("t"), (F.col("id") % n + 1).cast("int").alias("round"))
    return rounds.join(order.select("round", "query_id"), "round").select("t", "query_id")


def shuffled_epochs(spark: SparkSession, order: DataFrame, epochs: int, chunk: int, seed: int = 42) -> DataFrame:
    """(epoch, place, query_id): every epoch replays the chunks in a new order, the queries of a chunk in theirs."""
    rows = order.select("query_id", ((F.col("round") - 1) / chunk).cast("int").alias("chunk"), ((F.col("round") - 1) % chunk).alias("inner"))
    sizes = rows.groupBy("chunk").count().crossJoin(spark.range(epochs).select(F.col("id").cast("int").alias("epoch")))
    before = Window.partitionBy("epoch").orderBy(uniform(seed, "chunk", "epoch", "chunk"), "chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("epoch", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    # A row for each epoch and chunk: their number grows with the table, so whether it is broadcast is left to the plan.
    return rows.join(starts, "chunk").select("epoch", (F.col("start") + F.col("inner")).cast("long").alias("place"), "query_id")


def sampled(queries: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``size`` queries without replacement (all, if fewer): those with the smallest draws."""
    return queries.select("query_id").distinct().orderBy(uniform(seed, "res", "query_id"), "query_id").limit(size)
