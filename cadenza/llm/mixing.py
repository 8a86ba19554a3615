"""Mixing sources to target weights, with DataFrame functions only.

Sizes are added up per source, the weights give each source a target, and target / size is the
repetition rate. Every document is taken floor(rate) times, and once more if a draw that hangs
on its id alone falls below the fraction of the rate.

Defined results: a null or empty text has size 0; a null source is one source, ordered last; rows
that repeat a doc_id share one draw; a row without doc_id draws by its text; a source of size 0
has target 0 and is not taken; an empty table gives an empty result. Columns whose names begin
with __cz_ are the operator's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import small_side, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 17


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: str, text: str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 of seed and id."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"mix:{seed}:"), key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each source: __cz_source, __cz_source_size, __cz_target.

    sizes has a row per document with __cz_source and __cz_size; it is reduced to a row per source
    before anything is ordered. The targets share the sum of all sizes by weight. A target
    stops at max_repeats times its source's size; what is over goes to the others by weight. With the
    sources in order of size / weight, the first ones are those that stop, so one running sum
    finds the common share of a unit of weight.
    """
    per_source = sizes.groupBy("__cz_source").agg(F.sum("__cz_size").alias("__cz_source_size"))
    by_name, everything = W.orderBy(F.col("__cz_source").asc_nulls_last()), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    position = F.row_number().over(by_name) - 1
    weighed = per_source.withColumn("__cz_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (position % len(weights) + 1).cast("int")))
    by_room = W.orderBy(F.col("__cz_source_size") / F.col("__cz_weight"), F.col("__cz_source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    cap = F.lit(float(max_repeats)) * F.col("__cz_source_size")
    return (
        weighed.withColumn("__cz_rank", F.row_number().over(by_room))
        .withColumn("__cz_left", F.sum("__cz_source_size").over(everything) - max_repeats * F.coalesce(F.sum("__cz_source_size").over(before), F.lit(0)))
        .withColumn("__cz_left_weight", F.sum("__cz_weight").over(everything) - F.coalesce(F.sum("__cz_weight").over(before), F.lit(0.0)))
        .withColumn("__cz_share", F.col("__cz_left") / F.col("__cz_left_weight"))
        .withColumn("__cz_open", F.min(F.when(cap >= F.col("__cz_share") * F.col("__cz_weight"), F.col("__cz_rank"))).over(everything))
        .withColumn("__cz_share", F.max(F.when(F.col("__cz_rank") == F.col("__cz_open"), F.col("__cz_share"))).over(everything))
        .select("__cz_source", "__cz_source_size", F.when(F.col("__cz_rank") < F.col("__cz_open"), cap).otherwise(F.least(cap, F.col("__cz_share") * F.col("__cz_weight"))).alias("__cz_target"))
    )


def with_copies(sized: DataFrame, targets: DataFrame, id_column: str, text_column: str, seed: int = SEED) -> DataFrame:
    """sized (with __cz_source) plus __cz_source_size, __cz_target and __cz_copies, how often the mix takes the row."""
    rate = F.when(F.col("__cz_source_size") > 0, F.least(F.lit(float(MAX_REPEATS)), F.col("__cz_target") / F.col("__cz_source_size"))).otherwise(0.0)
    per_source = small_side(targets).withColumnRenamed("__cz_source", "__cz_key")
    return (
        sized.join(per_source, F.col("__cz_source").eqNullSafe(F.col("__cz_key")), "left")
        .withColumn("__cz_copies", (F.floor(rate) + (draw(id_column, text_column, seed) < rate - F.floor(rate)).cast("long")).cast("long"))
        .drop("__cz_key")
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken."""
    sized = docs.withColumns({"__cz_source": F.col(source_column), "__cz_size": word_count(text_column)})
    targets = staged(source_targets(sized.select("__cz_source", "__cz_size")), "mix-targets")
    taken = with_copies(docs.withColumn("__cz_source", F.col(source_column)), targets, id_column, text_column, seed)
    copies = taken.where("__cz_copies > 0").withColumn("__cz_copy", F.explode(F.sequence(F.lit(1), F.col("__cz_copies").cast("int"))))
    return copies.select(*docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.when(F.col("doc_id").isNull(), F.col("text")).alias("text")
    sized = staged(docs.select("doc_id", text, F.col("source").alias("__cz_source"), word_count("text").alias("__cz_size")), "mix-sizes")
    targets = staged(source_targets(sized), "mix-targets")
    return with_copies(sized, targets, "doc_id", "text").select(
        "doc_id",
        F.col("__cz_size").alias("size"),
        F.col("__cz_source_size").alias("source_size"),
        F.col("__cz_target").alias("target"),
        (F.col("__cz_size") * F.col("__cz_copies")).alias("taken"),
    )


OP1_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM per_source
), ranked AS (
  SELECT *, row_number() OVER o AS rk,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER p, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS share
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source ASC NULLS LAST),
    p AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, min(CASE WHEN 3.0::DOUBLE * source_size >= share * weight THEN rk END) OVER () AS open_rank FROM ranked
), shared AS (
  SELECT *, max(CASE WHEN rk = open_rank THEN share END) OVER () AS unit FROM opened
), targets AS (
  SELECT source, source_size, CASE WHEN rk < open_rank THEN 3.0::DOUBLE * source_size ELSE least(3.0::DOUBLE * source_size, unit * weight) END AS target FROM shared
), drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0.0::DOUBLE END AS rate,
    CAST(CAST('0x' || substr(md5('mix:{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null:' || md5(coalesce(s.text, '')))), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
"""
