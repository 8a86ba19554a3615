"""Search records: the results of each segment as one document, and flattening into training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cadenza.functions import scoring
from cadenza.functions.params import short
from cadenza.operators.select import TOP_K
from cadenza.sources.views import FEATURES, SEQ

#: The columns of a dataset, in order (fixed values).
META = ("source", "segment", "segment_hash", "target", "feasible", "vmaf", "rate", "ratio", "score", "encoder", "n_trials")
LABELS = ("crf", "aq_mode", "aq_strength")
COLUMNS = (*META, *FEATURES, *LABELS)


def results(rated: DataFrame, k: int = TOP_K, seq: tuple[str, ...] = SEQ) -> DataFrame:
    """A row per segment and target: the best trial (of highest quality where none is feasible), its k best feasible trials, counts.

    One pass if rated is dealt out by segment: the ranking, the counts and all that follows go on where it lies.
    """
    part = W.partitionBy("segment_hash", "target")
    order = part.orderBy(F.desc("feasible"), F.desc(F.when(F.col("feasible"), F.col("score")).otherwise(F.col("vmaf"))), *seq)
    scored = scoring.with_score(rated).drop("compression", "quality")
    ranked = scored.withColumns({"rank": F.row_number().over(order), "n_trials": F.count(F.lit(1)).over(part)}).where(F.col("rank") <= max(1, k))
    params = F.struct("crf", "aq_mode", "aq_strength")
    choice = F.struct("rank", params.alias("params"), "vmaf", "rate", scoring.compression_ratio(F.col("rate")).alias("ratio"), "score", "feasible")
    per = ranked.groupBy("segment_hash", "target").agg(F.max("source").alias("source"), F.max("encoder").alias("encoder"), F.max("n_trials").alias("n_trials"), F.array_sort(F.collect_list(choice)).alias("t"))
    return per.select("segment_hash", "source", "encoder", "target", "n_trials", F.col("t")[0].alias("best"), F.filter("t", lambda c: c["feasible"]).alias("top"))


def nested(found: DataFrame, features: DataFrame) -> DataFrame:
    """found (rows of results) and features (segment_hash and the eight numbers) as a record per segment; segments without features have none."""
    b = F.col("best")
    result = F.struct(
        b["feasible"].alias("feasible"), b["vmaf"].alias("vmaf"), b["rate"].alias("rate"), b["ratio"].alias("ratio"), b["score"].alias("score"), F.col("n_trials"), b["params"].alias("params"),
        F.transform("top", lambda c: F.struct(c["params"].alias("params"), c["vmaf"].alias("vmaf"), c["rate"].alias("rate"), c["ratio"].alias("ratio"), c["score"].alias("score"))).alias("top_params"),
    )
    entries = F.array_sort(F.collect_list(F.struct(short(F.col("target")).alias("key"), result.alias("value"))))
    records = found.groupBy("segment_hash").agg(F.max("source").alias("source"), F.max("encoder").alias("encoder"), F.map_from_entries(entries).alias("results"))
    said = F.create_map(*[x for c in FEATURES for x in (F.lit(c), F.bround(c, 6))])
    path = F.concat(F.lit("segments/"), F.col("segment_hash"), F.lit(".mkv"))
    return records.join(features.select("segment_hash", said.alias("features")), "segment_hash", "left").select(path.alias("segment_path"), "segment_hash", "source", "encoder", "features", "results")


def to_lines(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(*records.columns)).alias("line"))


def infeasible(records: DataFrame) -> DataFrame:
    """Per encoder how many results there are and how many of them met no target."""
    each = records.select("encoder", F.explode(F.map_values("results")).alias("r"))
    return each.groupBy("encoder").agg(F.count(F.lit(1)).alias("n_results"), F.count_if(~F.col("r.feasible")).alias("n_infeasible"))


def dataset_rows(records: DataFrame) -> DataFrame:
    """A row with all COLUMNS (and rank) for each candidate of each segment and target, or for the chosen trial where there are none
    and it is feasible. Infeasible results give no row."""
    per = records.select("source", F.col("segment_path").alias("segment"), "segment_hash", "encoder", "features", F.explode("results").alias("target", "r"))
    one = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("params", "vmaf", "rate", "ratio", "score")])
    choices = F.when(F.size("r.top_params") > 0, F.col("r.top_params")).when(F.col("r.feasible"), F.array(one))
    rows = per.select("*", F.posexplode(choices).alias("place", "c"))
    return rows.select(
        "source", "segment", "segment_hash", F.col("target").cast("double").alias("target"), F.lit(True).alias("feasible"), F.bround("c.vmaf", 3).alias("vmaf"), F.bround("c.rate", 6).alias("rate"), F.bround("c.ratio", 3).alias("ratio"),
        F.bround("c.score", 5).alias("score"), "encoder", F.col("r.n_trials").alias("n_trials"), *[F.try_element_at("features", F.lit(c)).alias(c) for c in FEATURES], F.col("c.params.crf").alias("crf"),
        F.col("c.params.aq_mode").alias("aq_mode"), F.col("c.params.aq_strength").alias("aq_strength"), (F.col("place") + 1).cast("int").alias("rank"),
    )


def write_dataset(rows: DataFrame, path: str) -> None:
    """Training rows as CSV with a header, in the fixed order of columns."""
    rows.select(*COLUMNS).write.mode("overwrite").csv(path, header=True)


def read_dataset(spark, path: str) -> DataFrame:
    """The rows of a dataset, as strings; an error if it is empty or lacks a column."""
    rows = spark.read.csv(path, header=True, schema=None, inferSchema=False)
    missing = sorted(set(COLUMNS) - set(rows.columns))
    if missing or rows.isEmpty():
        raise ValueError(f"{path}: {'no rows' if not missing else f'columns missing: {missing}'}")
    return rows


def no_trials(spark) -> DataFrame:
    """What a store that is switched off holds: no trial, with the columns of one."""
    kinds = {"segment_hash": "string", "encoder": "string", "crf": "double", "aq_mode": "int", "aq_strength": "double", "vmaf_model": "string", "n_subsample": "int", "ref_bytes": "bigint", "out_bytes": "bigint", "vmaf": "double", "key": "string"}
    return spark.createDataFrame([], T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in kinds.items())))
