"""Summaries of result documents and profiles of query groups.

Result documents are JSON objects; keys that are arms' names are read as maps.
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import groups

RESULT_DDL = (
    "config struct<scenario:string,policy:string,arms:array<string>,arm_pool_size:string,n_rounds:long,seed:long,hierarchical:boolean>, "
    "metrics struct<iterations:long,total_ndcg_regret:double,avg_ndcg_regret:double,total_clicks:long,click_rate:double>, "
    "selection_rates map<string,double>, win_rates map<string,double>, policy_stats struct<set_E:array<string>,set_F:array<string>,t:long>, "
    "inference_stats struct<total_inferences:long,avg_arms_per_query:double>, logical_cost struct<total_evaluations:long,avg_arms_per_query:double,total_queries:long>, runtime double"
)

#: Arms of the pools that results are told apart by (fixed values).
BASE_POOL = ("random", "single_feature", "xgboost", "linucb")
LEARNING_POOL = ("linear_ts", "linucb", "xgboost")
LEARNING_ARMS = ("linear_ts", "linucb")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result documents with ``filename``; none where the folder has none or doesn't exist."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    if not root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(root):
        return spark.createDataFrame([], f"{RESULT_DDL}, filename string")
    rows = spark.read.schema(RESULT_DDL).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("filename", F.col("_metadata.file_name"))


def store_results(spark: SparkSession, results: dict[str, dict], folder: str) -> None:
    """Result documents by file name, in a folder wherever Spark's file systems reach."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for name, result in results.items():
        out = files.create(jvm.org.apache.hadoop.fs.Path(root, name), True)
        out.write(bytearray(json.dumps(result, default=str).encode()))
        out.close()


def save_result(result: dict, path: str | None = None, folder: str = "results") -> str:
    """Writes one result document to a file of the driver's; values that JSON lacks become strings."""
    if path is None:
        config = result.get("config", {})
        path = str(Path(folder) / f"{datetime.now():%Y%m%d_%H%M%S}_{config.get('scenario')}_{config.get('policy')}.json")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(result, indent=2, default=str))
    return path


def pool_of(arms: Column) -> Column:
    """base_pool, learning_only or full_pool by the set of arms."""
    literal = lambda names: F.array(*[F.lit(n) for n in sorted(names)])
    own = F.array_sort(F.array_distinct(arms))
    return F.when(own == literal(BASE_POOL), "base_pool").when(own == literal(LEARNING_POOL), "learning_only").otherwise("full_pool")


def categorized(results: DataFrame) -> DataFrame:
    return results.withColumn("pool", pool_of(F.col("config.arms")))


def policy_comparison(results: DataFrame) -> DataFrame:
    """Means a scenario, pool and policy."""
    m = F.col("metrics.total_ndcg_regret"), F.col("metrics.avg_ndcg_regret"), F.col("metrics.click_rate"), F.col("inference_stats.avg_arms_per_query"), F.col("runtime")
    names = ("total_regret", "avg_regret", "click_rate", "arms_per_query", "runtime")
    return categorized(results).groupBy(F.col("config.scenario").alias("scenario"), "pool", F.col("config.policy").alias("policy")).agg(F.count(F.lit(1)).alias("runs"), *[F.avg(c).alias(n) for c, n in zip(m, names, strict=True)])


def convergence(results: DataFrame, policy: str = "mdb") -> DataFrame:
    """Final sets of runs of a policy."""
    rows = results.where(F.col("config.policy") == policy)
    return rows.select("filename", F.col("config.scenario").alias("scenario"), F.col("config.seed").alias("seed"), F.array_join("policy_stats.set_E", ",").alias("set_e"), F.array_join("policy_stats.set_F", ",").alias("set_f"))


def arm_performance(results: DataFrame) -> DataFrame:
    """Mean selection and win rates a scenario and arm; an arm that never won counts with 0."""
    rows = results.select(F.col("config.scenario").alias("scenario"), F.explode("selection_rates").alias("arm", "selection"), "win_rates")
    won = F.coalesce(F.try_element_at("win_rates", F.col("arm")), F.lit(0.0))
    return rows.withColumn("win", won).groupBy("scenario", "arm").agg(F.avg("selection").alias("selection_rate"), F.avg("win").alias("win_rate"))


def reproducibility(results: DataFrame) -> DataFrame:
    """Mean and sample deviation of the regret over seeds; the deviation is 0 for a single run."""
    rows = results.groupBy(F.col("config.scenario").alias("scenario"), F.col("config.policy").alias("policy"))
    r = F.col("metrics.total_ndcg_regret")
    return rows.agg(F.count(F.lit(1)).alias("runs"), F.avg(r).alias("mean_regret"), F.coalesce(F.when(F.count(F.lit(1)) > 1, F.stddev_samp(r)), F.lit(0.0)).alias("sd_regret"))


def key_findings(results: DataFrame, baseline: str = "uniform") -> DataFrame:
    """(scenario, policy, reduction): percent less regret than the baseline, of each one's first run by file name."""
    first = results.groupBy(F.col("config.scenario").alias("scenario"), F.col("config.policy").alias("policy")).agg(F.min_by(F.col("metrics.total_ndcg_regret"), F.col("filename")).alias("regret"))
    base = first.where(F.col("policy") == baseline).select("scenario", F.col("regret").alias("base"))
    return first.where(F.col("policy") != baseline).join(base, "scenario").select("scenario", "policy", F.coalesce(F.try_divide((F.col("base") - F.col("regret")) * 100, F.col("base")), F.lit(0.0)).alias("reduction"))


def learning_only(results: DataFrame, policy: str = "mdb") -> DataFrame:
    """One row (runs, mean_regret) of a policy's runs with learning arms alone; the mean is null without runs."""
    own = F.array_sort(F.array_distinct(F.col("config.arms"))) == F.array(*[F.lit(a) for a in sorted(LEARNING_ARMS)])
    rows = results.where(own & (F.col("config.policy") == policy))
    return rows.agg(F.count(F.lit(1)).alias("runs"), F.avg("metrics.total_ndcg_regret").alias("mean_regret"))


def cost_findings(results: DataFrame, baseline: str = "uniform") -> DataFrame:
    """(scenario, policy, reduction): percent fewer inferences than the baseline, of each one's first run by file name."""
    first = results.groupBy(F.col("config.scenario").alias("scenario"), F.col("config.policy").alias("policy")).agg(F.min_by(F.col("inference_stats.total_inferences"), F.col("filename")).alias("cost"))
    base = first.where(F.col("policy") == baseline).select("scenario", F.col("cost").alias("base"))
    return first.where(F.col("policy") != baseline).join(base, "scenario").select("scenario", "policy", F.coalesce(F.try_divide((F.col("base") - F.col("cost")) * 100, F.col("base")), F.lit(0.0)).alias("reduction"))


def report(spark: SparkSession, folder: str) -> dict[str, list[dict]]:
    """Every summary of the result documents in a folder, by name; no documents give none."""
    results = read_results(spark, folder).persist()
    try:
        if results.isEmpty():
            return {}
        made = {
            "policy_comparison": policy_comparison(results), "convergence": convergence(results), "arm_performance": arm_performance(results), "reproducibility": reproducibility(results),
            "regret_findings": key_findings(results), "cost_findings": cost_findings(results), "common_survivor": common_survivor(results), "learning_only": learning_only(results),
        }
        return {name: [r.asDict(recursive=True) for r in rows.orderBy(*rows.columns[:3]).collect()] for name, rows in made.items()}
    finally:
        results.unpersist()


def common_survivor(results: DataFrame) -> DataFrame:
    """(scenario, arm, times): the arm most often in the final set; ties by name."""
    rows = results.select(F.col("config.scenario").alias("scenario"), F.explode("policy_stats.set_E").alias("arm")).groupBy("scenario", "arm").agg(F.count(F.lit(1)).alias("times"))
    best = Window.partitionBy("scenario").orderBy(F.desc("times"), "arm")
    return rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").select("scenario", "arm", "times")


def named_by_file(results: DataFrame) -> DataFrame:
    """Adds phase, config_id, seed and name, taken from ``phase_config_name..._seed-n.json``."""
    rows = results.withColumn("__p", F.split(F.regexp_replace("filename", r"\.json$", ""), "_"))
    parts = F.expr("slice(__p, 3, greatest(size(__p) - 3, 0))")
    rows = rows.withColumn("__n", parts)
    joined = F.array_join("__n", "_")
    arms = F.when(F.startswith(F.get("__n", F.lit(0)), F.lit("K")), F.get("__n", F.lit(0))).otherwise(F.try_element_at("__n", F.lit(-1)))
    name = F.when((F.get("__p", F.lit(0)) == "phase2") & joined.contains("Flat"), F.concat(F.lit("Flat_"), arms)).when((F.get("__p", F.lit(0)) == "phase2") & joined.contains("HMDB"), F.concat(F.lit("HMDB_"), arms)).otherwise(joined)
    seed = F.regexp_extract(F.try_element_at("__p", F.lit(-1)), "seed-([0-9]+)", 1).cast("int")
    return rows.select(*results.columns, F.get("__p", F.lit(0)).alias("phase"), F.get("__p", F.lit(1)).alias("config_id"), seed.alias("seed"), name.alias("name"))


def phase_summary(results: DataFrame) -> DataFrame:
    """Means, and the deviation of the whole set of runs, a name."""
    rows = named_by_file(results)
    r = F.coalesce(F.col("metrics.total_ndcg_regret"), F.lit(0.0))
    return rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(r).alias("regret"), F.stddev_pop(r).alias("regret_sd"), F.avg(F.coalesce(F.col("logical_cost.total_evaluations"), F.lit(0))).alias("inferences"), F.avg("runtime").alias("runtime")
    )


def scalability(summary: DataFrame) -> DataFrame:
    """(k, cost_reduction, regret_reduction) in percent, of HMDB_K against Flat_K."""
    flat = summary.where(F.col("name").startswith("Flat_K")).select(F.substring("name", 6, 20).alias("k"), F.col("regret").alias("fr"), F.col("inferences").alias("fi"))
    two = summary.where(F.col("name").startswith("HMDB_K")).select(F.substring("name", 6, 20).alias("k"), F.col("regret").alias("hr"), F.col("inferences").alias("hi"))
    less = lambda a, b: F.coalesce(F.try_divide((F.col(a) - F.col(b)) * 100, F.col(a)), F.lit(0.0))
    return flat.join(two, "k").where("k in ('K20', 'K60', 'K100')").select("k", less("fi", "hi").alias("cost_reduction"), less("fr", "hr").alias("regret_reduction"))


def profile_splits(spark: SparkSession, folder: str, path: str | None = None, limit: int | None = None) -> dict:
    """The profile of every set and split below ``folder`` that has chunk files, by set and split; written as JSON to
    ``path`` where one is given. Splits whose folder has no chunks say so. All chunks are read and grouped at once."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(conf)
    out: dict = {}
    chunks: list[str] = []
    for own in sorted((s.getPath() for s in files.listStatus(root) if s.isDirectory() and not s.getPath().getName().startswith("_")), key=lambda p: p.getName()):
        out[own.getName()] = {}
        for split in ("train", "valid", "test"):
            at = jvm.org.apache.hadoop.fs.Path(own, split)
            if files.exists(at):
                found = groups.chunk_files(spark, at.toString(), limit)
                out[own.getName()][split] = {"error": "no chunks"}
                chunks += found
    if chunks:
        place = F.regexp_extract(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), "([^/]+)/([^/]+)/[^/]+$", 1), F.regexp_extract(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), "([^/]+)/([^/]+)/[^/]+$", 2)
        rows = spark.read.parquet(*chunks).withColumn("__set", place[0]).withColumn("__split", place[1])
        for r in profile(groups.flat(groups.checked(rows, "__set", "__split"), "__set", "__split"), "__set", "__split").collect():
            told = r.asDict()
            out[told.pop("__set")][told.pop("__split")] = told
    if path is not None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(out, indent=2, default=str))
    return out


def summary_lines(profiles: dict) -> list[str]:
    """What ``profile_splits`` found, as text."""
    out = []
    for name, splits in profiles.items():
        for split, p in splits.items():
            if "error" in p:
                out.append(f"{name}/{split}: {p['error']}")
                continue
            grades = ", ".join(f"{g}: {p[f'grade_{g}']} ({100 * p[f'grade_{g}'] / p['documents'] if p['documents'] else 0:.1f} %)" for g in range(5))
            out.append(f"{name}/{split}: {p['queries']} queries, {p['documents'] or 0} documents, {p['mean_docs'] or 0:.1f} a query ({p['min_docs']} to {p['max_docs']}); grades {grades}")
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Profiles query groups, or sums up result documents")
    parser.add_argument("--data-dir", help="folder of sets and splits to profile")
    parser.add_argument("--results", help="folder of result documents to sum up")
    parser.add_argument("--output", help="JSON file to write")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("rankloom").getOrCreate()
    if given.data_dir:
        print("\n".join(summary_lines(profile_splits(spark, given.data_dir, given.output))))
    if given.results:
        found = report(spark, given.results)
        print(json.dumps(found, indent=2, default=str) if found else "no results")
        if given.output and not given.data_dir:
            Path(given.output).write_text(json.dumps(found, indent=2, default=str))


def profile(docs: DataFrame, *by: str) -> DataFrame:
    """One row (for each group of the ``by`` columns): counts of queries and documents, documents a query, relevance grades
    0 to 4, and the features' span.

    Features are summed as decimals of nine digits after the point, so that the mean doesn't depend on their order; those
    that aren't finite count as 0 in the sum.
    """
    sizes = docs.groupBy(*by, "query_id").agg(F.count(F.lit(1)).alias("n"))
    a = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("documents"), F.min("n").alias("min_docs"), F.max("n").alias("max_docs"), F.avg("n").alias("mean_docs"), F.median("n").alias("median_docs"))
    grades = [F.sum((F.col("rel") == g).cast("long")).alias(f"grade_{g}") for g in range(5)]
    least = F.min(F.array_min("features")).alias("feature_min"), F.max(F.array_max("features")).alias("feature_max")
    exact = F.expr("aggregate(features, cast(0 as decimal(28, 9)), (s, x) -> cast(s + coalesce(try_cast(x as decimal(24, 9)), 0) as decimal(28, 9)))")
    total = F.sum(exact).cast("double") / F.sum(F.size("features"))
    b = docs.groupBy(*by).agg(*grades, *least, total.alias("feature_mean"))
    return a.join(b, list(by)) if by else a.crossJoin(b)


if __name__ == "__main__":
    main()
