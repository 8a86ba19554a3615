"""Documents about segments, runs and models: manifests read row by row, the gates on them, and the documents that are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Model metadata as JSON; ranges by feature.
METADATA = (
    "schema_version int, encoder string, target double, feature_names array<string>, label_names array<string>, n_train bigint, n_val bigint, training_targets array<double>, metrics map<string,double>, "
    "feature_ranges map<string,array<double>>, training_sources array<string>, config map<string,string>, created_at string"
)
#: Metadata versions: a bundle for one target, and a unified one (fixed values).
FOR_TARGET, UNIFIED = 1, 2


def segment_rows(manifests: DataFrame) -> DataFrame:
    """The segments of manifests (doc, manifest: a JSON array): doc, index, path, source, start, duration. Items that lack a key or hold
    no number where one belongs are skipped, and a manifest that is no array has none."""
    items = manifests.select("doc", F.explode(F.from_json("manifest", "array<string>")).alias("item"))
    said = F.from_json("item", "map<string,string>")
    got = items.select("doc", *[F.try_element_at(said, F.lit(k)).alias(k) for k in ("index", "path", "source", "start", "duration")])
    typed = got.select("doc", F.col("index").try_cast("int").alias("index"), "path", "source", *[F.col(k).try_cast("double").alias(k) for k in ("start", "duration")])
    return typed.dropna(subset=["index", "path", "source", "start", "duration"])


def resumed(sources: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """The wanted sources' segments whose files (path) exist."""
    return segments.join(sources, "source", "left_semi").join(files, "path", "left_semi")


def to_cut(sources: DataFrame, reused: DataFrame) -> DataFrame:
    """The wanted sources without a segment to reuse."""
    return sources.join(reused, "source", "left_anti")


def complete(segments: DataFrame, files: DataFrame) -> DataFrame:
    """The segments of those documents and sources all of whose files exist: one missing file empties the result for its source."""
    there = segments.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    whole = there.groupBy("doc", "source").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("whole")).where("whole")
    return segments.join(whole.select("doc", "source"), ["doc", "source"], "left_semi")


def metadata_json(columns: dict[str, Column]) -> Column:
    """A metadata document; keys that are null are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in columns.items()]))


def metadata(documents: DataFrame, column: str = "document") -> DataFrame:
    """Metadata documents as rows; those that are no metadata (no version or encoder, or a version that is not known) go."""
    parsed = documents.withColumn("m", F.from_json(column, METADATA)).where("m.schema_version IS NOT NULL AND m.encoder IS NOT NULL")
    return parsed.where(F.col("m.schema_version").isin(FOR_TARGET, UNIFIED)).select(*[c for c in documents.columns if c != column], "m.*")


def package_manifest(bundles: DataFrame) -> DataFrame:
    """Per encoder a package document that lists its bundles (encoder, path, target, hit_rate) in the order of their paths."""
    one = F.struct("path", "encoder", "target", "hit_rate")
    return bundles.groupBy("encoder").agg(F.to_json(F.struct(F.lit("compress").alias("package"), F.array_sort(F.collect_list(one)).alias("models"))).alias("manifest"))


def run_summary(records: DataFrame, rows: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """Per encoder the summary of a run as JSON: sources, segments, training rows, infeasible results and targets."""
    bad = F.size(F.filter(F.map_values("results"), lambda r: ~r["feasible"]))
    seen = records.groupBy("encoder").agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("segments"), F.sum(bad).alias("infeasible"))
    made = rows.groupBy("encoder").agg(F.count(F.lit(1)).alias("rows"))
    said = F.struct("sources", "segments", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"), "infeasible", "encoder", F.array(*map(F.lit, targets)).alias("targets"))
    return seen.join(made, "encoder", "left").select("encoder", F.to_json(said).alias("summary"))
