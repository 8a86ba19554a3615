"""A stored table of measured trials: bucketed by segment, appended in batches, compacted, one row for each key.

Each generation is a Parquet table in BUCKETS buckets of segments; a put adds files to it and a line to a commit log. Rows carry the name of
their put, and only puts that the log names count, so one that dies half way is never seen. Of rows with one key the one put last
counts. A key belongs to one segment, so buckets stand for a shuffle: neither that choice nor a lookup moves what is stored, only the proposals are
dealt out by the same hash. After COMPACT_AFTER puts the rows that count are written as the next generation, which replaces the ones before.

A key is (segment, encoder, parameters rounded as they are encoded, model, subsample), as functions.params.trial_key writes it.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions import params as P
from cadenza.operators.store import key
from cadenza.plans.rounds import Measure, dealt, kept, mark
from cadenza.sources import commitlog

BUCKETS = 32
COMPACT_AFTER = 32
#: The columns of a stored trial.
STORED = "segment_hash string, key string, encoder string, crf double, aq_mode int, aq_strength double, vmaf_model string, n_subsample int, ref_bytes bigint, out_bytes bigint, vmaf double"
_NAMES = [c.split()[0] for c in STORED.split(", ")]
_KEY = {"key": "string"}


class TrialStore:
    """The store in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _table(self, generation: int) -> str:
        """The catalogue's name of a generation, which any session can enter again: its files tell their buckets."""
        name = f"trials_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{generation}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({STORED}, put string) USING parquet CLUSTERED BY (segment_hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/generation-{generation}'")
        return name

    def _puts(self) -> DataFrame:
        """batch, generation and put of the puts that count: at most COMPACT_AFTER, and one."""
        said = F.from_json("said", "generation int, put string")
        return commitlog.commits(self.spark, self.path).select("batch", said.alias("s")).select("batch", "s.generation", "s.put")

    def generation(self) -> int:
        return self._puts().agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def _written(self, rows: DataFrame, generation: int, lies: bool = False) -> str:
        """Adds files to a generation, without a commit. lies: the rows lie by segment, in as many parts as there are buckets."""
        name, put = self._table(generation), uuid.uuid4().hex
        rows = rows.select(*_NAMES, F.lit(put).alias("put"))
        (rows if lies else dealt(rows, self.buckets)).write.insertInto(name)
        self.spark.catalog.refreshTable(name)
        return put

    def put(self, trials: DataFrame, order: tuple[str, ...] = ()) -> int:
        """Stores trials (the columns of STORED but for key); of equal keys the last by order. Returns the number of the put."""
        last = W.partitionBy("__mark", "segment_hash", "key").orderBy(*[F.desc(c) for c in (order or ("vmaf",))])
        columns = dict.fromkeys((*[c for c in _NAMES if c != "key"], *order))
        rows = dealt(trials.where("vmaf IS NOT NULL").select(*columns), self.buckets).withColumn("key", key()).withColumn("__mark", mark(**_KEY)).withColumn("__n", F.row_number().over(last)).where("__n = 1")
        return self._put(rows)

    def _put(self, rows: DataFrame) -> int:
        """Stores rows, one for each key, which lie by segment."""
        generation = self.generation()
        number = self._committed(self._written(rows, generation, True), generation, False)
        if self._puts().count() > COMPACT_AFTER:
            self.compact()
        return number

    def _committed(self, put: str, generation: int, replaces: bool) -> int:
        return commitlog.commit(self.spark, self.path, [put], replaces, json.dumps({"generation": generation, "put": put}))

    def current(self, *more: str) -> DataFrame:
        """One row for each key: the last put. more: what the choice went by (__mark)."""
        puts = self._puts().select("batch", "put")
        rows = self.spark.table(self._table(self.generation())).join(F.broadcast(puts), "put")  # COMPACT_AFTER rows and one
        last = W.partitionBy("__mark", "segment_hash", "key").orderBy(F.desc("batch"))
        return rows.withColumn("__mark", mark(**_KEY)).withColumn("__n", F.row_number().over(last)).where("__n = 1").select(*_NAMES, *more)

    def compact(self) -> int:
        """Writes what counts as the next generation. Readers of the old one may go on; the one before that is removed."""
        generation = self.generation()
        number = self._committed(self._written(self.current(), generation + 1, True), generation + 1, True)
        if generation:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(generation - 1)}")
            commitlog.Folder(self.spark, self.path).remove(f"generation-{generation - 1}")
        return number

    def lookup(self, proposals: DataFrame) -> DataFrame:
        """Proposals (with a key) with what is stored under it: vmaf, out_bytes, ref_bytes, and whether there is something (hit)."""
        return self._found(dealt(proposals, self.buckets))

    def _found(self, proposals: DataFrame) -> DataFrame:
        known = self.current("__mark").select("__mark", "segment_hash", "key", "vmaf", "out_bytes", "ref_bytes")
        found = proposals.withColumn("__mark", mark(**_KEY)).join(known, ["__mark", "segment_hash", "key"], "left").withColumn("hit", F.col("vmaf").isNotNull())
        return found.select(*proposals.columns, "vmaf", "out_bytes", "ref_bytes", "hit")

    def evaluated(self, proposals: DataFrame, spaces: DataFrame, measure: Measure, model: str, subsample: int, lies: bool = False) -> DataFrame:
        """Proposals moved into their space and rounded, with what is stored under their keys, or else measured, once for each key, and
        put into the store. stored tells which; proposals that could not be measured have no vmaf. lies: the proposals lie by segment already, in as
        many parts as the store has buckets."""
        placed = (proposals if lies else dealt(proposals, self.buckets)).join(F.broadcast(spaces), "encoder")  # a row per encoder
        moved = P.clamp(F.col("crf"), F.col("aq_mode"), F.col("aq_strength"), P.space_columns())
        asked = placed.withColumns({**moved, "vmaf_model": F.lit(model), "n_subsample": F.lit(subsample)}).select(*proposals.columns, "vmaf_model", "n_subsample").withColumn("key", key())
        met = kept(self._found(asked), self.buckets)
        numbers = [F.first(c).alias(c) for c in ("crf", "aq_mode", "aq_strength")]  # rounded, so those of a key are the same
        missed = met.where("NOT hit").groupBy("segment_hash", "key", "encoder").agg(*numbers).withColumns({"vmaf_model": F.lit(model), "n_subsample": F.lit(subsample)})
        new = kept(measure(missed).where("vmaf IS NOT NULL").select(*_NAMES), self.buckets)
        if not new.isEmpty():
            self._put(new)
        names = ("vmaf", "out_bytes", "ref_bytes")
        more = new.select(mark(**_KEY).alias("__mark"), "segment_hash", "key", *[F.col(c).alias(f"__{c}") for c in names])  # of keys that met nothing
        return met.withColumn("__mark", mark(**_KEY)).join(more, ["__mark", "segment_hash", "key"], "left").select(*asked.columns, *[F.coalesce(c, f"__{c}").alias(c) for c in names], F.col("hit").alias("stored"))
