"""Training of encoder parameters by target: a head per label, metrics on sources held out, refit, saving, loading, prediction."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import params as P
from cadenza.operators import boosting, modeling
from cadenza.plans.rounds import settled
from cadenza.sources.manifests import FOR_TARGET, METADATA, UNIFIED
from cadenza.sources.views import FEATURES

LABELS = ("crf", "aq_mode", "aq_strength")
TARGET_FEATURE = "vmaf_target"
_FORESTS = {"forest": RandomForestRegressionModel, "forest_classes": RandomForestClassificationModel}


@dataclass(frozen=True)
class Settings:
    """The least rows to fit on, the trees' number, depth, leaf size and step, the quantile of the crf, the share and seed of the split.
    estimator: gbt, or forest (half as many trees, 50 at least, squared loss for the crf too)."""

    estimator: str = "gbt"
    trees: int = 300
    depth: int = 4
    leaf: int = 4
    step: float = 0.06
    quantile: float = 0.15
    least_rows: int = 8
    share: float = 0.25
    seed: int = 0


@dataclass
class Bundle:
    """Per label its head (kind, model or value), and what is known of the training."""

    heads: dict[str, tuple[str, Any]]
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return list(self.metadata["feature_names"])


def needed(rows: DataFrame) -> DataFrame:
    """Of dataset rows the columns that training reads; what makes the others need not be worked out."""
    return rows.select("source", "segment_hash", "target", "feasible", *FEATURES, *LABELS)


def design_matrix(rows: DataFrame, target: float | None = None, *, feasible_only: bool = True, with_target: bool = False) -> DataFrame:
    """Dataset rows (strings or numbers) as features and labels: those of the target (within 1e-6) and of feasible results
    ("true" or "1"); with_target adds the target as a feature, for models of all targets."""
    kept = rows
    if target is not None:
        kept = kept.where(F.abs(F.col("target").cast("double") - target) < 1e-6)
    if feasible_only:
        kept = kept.where(F.lower(F.col("feasible").cast("string")).isin("true", "1"))
    numbers = [F.col(c).cast("double").alias(c) for c in FEATURES]
    if with_target:
        numbers.append(F.col("target").cast("double").alias(TARGET_FEATURE))
    return kept.select("source", "segment_hash", *numbers, F.col("crf").cast("double").alias("crf"), F.col("aq_mode").cast("double").cast("int").alias("aq_mode"), F.col("aq_strength").cast("double").alias("aq_strength"))


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__vector", handleInvalid="skip").transform(rows)


def _forest(rows: DataFrame, label: str, features: list[str], s: Settings) -> Any:
    kind = RandomForestClassifier if label == "aq_mode" else RandomForestRegressor
    made = kind(featuresCol="__vector", labelCol=label, maxDepth=s.depth, minInstancesPerNode=s.leaf, seed=s.seed, numTrees=max(50, s.trees // 2))
    return made.fit(_assembled(rows, features))


def _fit_heads(matrix: DataFrame, names: list[str] | dict[Any, list[str]], s: Settings) -> dict[Any, dict[str, tuple[str, Any]]]:
    """Per model (column model, a handful) and label its head: a constant where the label has one value, else boosted trees, of all models
    and heads at once, or a forest. names: the features, of all models or by model; those of each are the first of the longest list, and what comes after them has one value for it."""
    ends = {r["model"]: r for r in matrix.groupBy("model").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in LABELS for f in (F.min, F.max)]).collect()}
    of = names if isinstance(names, dict) else dict.fromkeys(ends, names)
    out = {m: {label: ("constant", float(r[f"min_{label}"])) for label in LABELS if r[f"min_{label}"] == r[f"max_{label}"]} for m, r in ends.items()}
    open_ = [label for label in LABELS if any(label not in heads for heads in out.values())]
    if s.estimator == "forest":
        for m, heads in out.items():
            for label in [label for label in open_ if label not in heads]:
                heads[label] = ("forest_classes" if label == "aq_mode" else "forest", _forest(matrix.where(F.col("model") == F.lit(m)), label, of[m], s))
    elif open_:
        losses = {"crf": boosting.Head("crf", "quantile", s.quantile), "aq_mode": boosting.Head("aq_mode", "classes"), "aq_strength": boosting.Head("aq_strength")}
        fitted = boosting.fit(matrix, "model", max(of.values(), key=len), [losses[label] for label in open_], s.trees, s.depth, s.leaf, s.step)
        for m, heads in out.items():
            for label in [label for label in open_ if label not in heads]:
                heads[label] = ("classes" if label == "aq_mode" else "gbt", fitted[m][label].of_first(len(of[m])))
    return out


def _predicted(rows: DataFrame, heads: dict[str, tuple[str, Any]], features: list[str]) -> DataFrame:
    """rows with raw predictions of all heads, in columns of the labels' names with _predicted. Forests pass over rows with missing features."""
    forests = any(kind.startswith("forest") for kind, _ in heads.values())
    out = _assembled(rows, features) if forests else rows
    for label, (kind, model) in heads.items():
        if kind.startswith("forest"):
            out = model.setPredictionCol("__prediction").transform(out).withColumnRenamed("__prediction", f"{label}_predicted").drop("rawPrediction", "probability")
        else:
            out = out.withColumn(f"{label}_predicted", F.lit(model) if kind == "constant" else model.column())
    return out.drop("__vector")


def _metrics(held: DataFrame) -> dict[Any, dict[str, float]]:
    """Per model what the heads do on rows held out: crf_mae, crf_bias, crf_r2, crf_hit_rate, crf_overshoot_p90, aq_mode_accuracy, aq_strength_mae."""
    r = modeling.regression_metrics(held, "model", F.col("crf"), F.col("crf_predicted"))
    same = (F.bround("aq_mode_predicted", 0).cast("int") == F.col("aq_mode")).cast("double")
    more = held.groupBy("model").agg(F.avg(same).alias("aq_mode_accuracy"), F.avg(F.abs(F.col("aq_strength_predicted") - F.col("aq_strength"))).alias("aq_strength_mae"))
    names = {"mae": "crf_mae", "bias": "crf_bias", "r2": "crf_r2", "hit_rate": "crf_hit_rate", "overshoot_p90": "crf_overshoot_p90"}
    rows = r.withColumnsRenamed(names).join(more, "model").collect()  # a row per model
    return {row["model"]: {k: row[k] for k in (*names.values(), "aq_mode_accuracy", "aq_strength_mae") if row[k] is not None} for row in rows}


def _trained(rows: DataFrame, encoder: str, targets: list[float | None], s: Settings) -> dict[float | None, Bundle]:
    """A bundle for each of targets, None being all of them with the target as a feature. All bundles, fitted without the sources held out and on all rows,
    grow at once: model 2 i is that of the i-th target on all rows, 2 i + 1 the one that is measured."""
    features = [*FEATURES, *([TARGET_FEATURE] if None in targets else [])]
    names = {t: features if t is None else list(FEATURES) for t in targets}
    numbered = dict(enumerate(targets))
    matrix = design_matrix(rows, with_target=True).persist()
    mine = F.array_compact(F.array(*[F.when(F.lit(True) if t is None else F.abs(F.col(TARGET_FEATURE) - t) < 1e-6, F.lit(i)) for i, t in numbered.items()]))
    told = {i: F.lit(float(t)) for i, t in numbered.items() if t is not None}  # a model of one target sees no other
    seen_as = F.coalesce(*[F.when(F.col("of") == i, v) for i, v in told.items()], F.col(TARGET_FEATURE)) if told else F.col(TARGET_FEATURE)
    of = matrix.withColumn("of", F.explode(mine)).withColumn(TARGET_FEATURE, seen_as)
    try:
        known = {r["of"]: r for r in of.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.collect_set("source").alias("s"), F.count_if(F.col("source").isNull()).alias("nameless"), *[f(c).alias(f"{f.__name__}_{c}") for c in features for f in (F.min, F.max)]).collect()}  # names go into the metadata
        for i, t in numbered.items():
            if (n := known[i]["n"] if i in known else 0) < s.least_rows:
                raise ValueError(f"{n} usable rows for target {t}; at least {s.least_rows} are needed")
        # all rows of a source are on one side, by the sources of each model
        sources = rows.sparkSession.createDataFrame([(i, name) for i, r in known.items() for name in (*r["s"], *([None] if r["nameless"] else []))], "of int, source string")
        out = reduce(DataFrame.unionByName, [modeling.validation_sources(sources.where(F.col("of") == i), s.share, s.seed).withColumn("of", F.lit(i)) for i in numbered])
        split = of.join(F.broadcast(settled(out).withColumn("validation", F.lit(True))), ["of", "source"], "left").withColumn("validation", F.coalesce("validation", F.lit(False)))
        both = F.when(F.col("validation"), F.array(2 * F.col("of"))).otherwise(F.array(2 * F.col("of"), 2 * F.col("of") + 1))
        heads = _fit_heads(split.withColumn("model", F.explode(both)), {2 * i + k: names[t] for i, t in numbered.items() for k in (0, 1)}, s)
        held = split.where("validation").withColumnRenamed("of", "model")
        n_held = {r["model"]: r["count"] for r in held.groupBy("model").count().collect()}
        judged = [_predicted(held.where(F.col("model") == i), heads[2 * i + 1], names[t]) for i, t in numbered.items() if 2 * i + 1 in heads]
        figures = _metrics(settled(reduce(DataFrame.unionByName, judged))) if judged and n_held else {}
        seen = targets_of(rows) if None in targets else None
    finally:
        matrix.unpersist()
    bundles = {}
    for i, t in numbered.items():
        b = known[i]
        metadata = {
            "schema_version": UNIFIED if t is None else FOR_TARGET, "encoder": encoder, "feature_names": names[t], "label_names": list(LABELS), "n_train": b["n"], "n_val": n_held.get(i, 0), "training_targets": seen if t is None else [t],
            "metrics": figures.get(i, {}) | {"crf_quantile": s.quantile}, "feature_ranges": {c: [b[f"min_{c}"], b[f"max_{c}"]] for c in names[t]}, "training_sources": sorted(b["s"]),
            "config": {"estimator": s.estimator, "trees": str(s.trees), "step": str(s.step), "depth": str(s.depth)},
        }
        bundles[t] = Bundle(heads[2 * i], metadata | ({} if t is None else {"target": t}))
    return bundles


def train(rows: DataFrame, encoder: str, target: float | None, settings: Settings = Settings()) -> Bundle:
    """One bundle: for a target, or with target None for all of them, the target being a feature. The heads are fitted on some sources
    and measured on the others; and fitted on all rows. An error if there are fewer than least_rows."""
    return _trained(rows, encoder, [target], settings)[target]


def targets_of(rows: DataFrame) -> list[float]:
    """The targets of dataset rows, ascending (a handful)."""
    return [r[0] for r in rows.select(F.col("target").cast("double").alias("t")).distinct().orderBy("t").collect()]


def train_all(rows: DataFrame, encoder: str, settings: Settings = Settings(), unified: bool = False) -> dict[float | None, Bundle]:
    """A bundle for each target of rows; unified: and at None one of all targets."""
    return _trained(rows, encoder, [*targets_of(rows), *([None] if unified else [])], settings)


def bundle_path(root: str, encoder: str, target: float | None) -> str:
    return f"{root}/{encoder}" if target is None else f"{root}/{encoder}/target_{target:g}"


_TREES = "label string, loss string, features array<string>, edges array<array<double>>, base array<double>, trees int, feature array<int>, cut array<int>, leaf array<double>, classes array<double>"


def save(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Boosted heads as rows of a table, forests in folders of their labels, and the metadata (with the constants) as one line of JSON."""
    boosted = {label: m for label, (kind, m) in bundle.heads.items() if isinstance(m, boosting.Model)}
    rows = [(label, m.loss, m.features, m.edges, m.base.tolist(), len(m.feature), m.feature.ravel().tolist(), m.cut.ravel().tolist(), m.leaf.ravel().tolist(), [float(c) for c in m.classes]) for label, m in boosted.items()]
    spark.createDataFrame(rows, _TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    for label, (kind, model) in bundle.heads.items():
        if kind.startswith("forest"):
            model.write().overwrite().save(f"{path}/{label}")
    heads = {k: f"{kind}:{model if kind == 'constant' else ''}" for k, (kind, model) in bundle.heads.items()}
    document = bundle.metadata | {"config": bundle.metadata["config"] | {f"head_{k}": v for k, v in heads.items()}}
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> Bundle:
    """The bundle saved at path; an error if its metadata are none, of another version or of other features."""
    row = spark.read.text(f"{path}/metadata").select(F.from_json("value", METADATA).alias("m")).first()
    m = row.m.asDict(recursive=True) if row and row.m and row.m.schema_version is not None else None
    if m is None or m["schema_version"] not in (FOR_TARGET, UNIFIED):
        raise ValueError(f"{path}: no metadata of a known version")
    wanted = [*FEATURES, *([TARGET_FEATURE] if m["schema_version"] == UNIFIED else [])]
    if m["feature_names"] != wanted:
        raise ValueError(f"{path}: made for other features: {m['feature_names']}")
    trees = {}
    for r in spark.read.schema(_TREES).parquet(f"{path}/trees").collect():  # a row per head
        shaped = [np.array(v).reshape(r.trees, len(r.base), -1) for v in (r.feature, r.cut, r.leaf)]
        trees[r.label] = boosting.Model(r.loss, list(r.features), [list(e) for e in r.edges], np.array(r.base), *shaped, list(r.classes))
    heads = {}
    for label in LABELS:
        kind, value = m["config"][f"head_{label}"].split(":")
        heads[label] = (kind, float(value) if kind == "constant" else _FORESTS[kind].load(f"{path}/{label}") if kind in _FORESTS else trees[label])
    return Bundle(heads, {k: v for k, v in m.items() if v is not None})


def predict(rows: DataFrame, bundle: Bundle, space: dict[str, Any], target: float | None = None) -> DataFrame:
    """rows (with the features, and the columns of the space) with crf, aq_mode and aq_strength, moved into the space."""
    unified = TARGET_FEATURE in bundle.features
    if unified and target is None:
        raise ValueError("this bundle needs a target")
    asked = rows.withColumn(TARGET_FEATURE, F.lit(float(target))) if unified else rows
    raw = _predicted(asked, bundle.heads, bundle.features)
    c = P.clamp(F.col("crf_predicted"), F.bround("aq_mode_predicted", 0).cast("int"), F.col("aq_strength_predicted"), space)
    return raw.withColumns(c).drop(*[f"{label}_predicted" for label in LABELS], *([TARGET_FEATURE] if unified else []))


def outside(rows: DataFrame, bundle: Bundle) -> DataFrame:
    """The values of rows that lie outside of what the bundle was trained on: segment_hash, feature, value, low, high."""
    spark = rows.sparkSession
    bounds = spark.createDataFrame([(k, *map(float, v)) for k, v in bundle.metadata["feature_ranges"].items() if k in FEATURES], "feature string, low double, high double")
    return modeling.violations(rows, bounds)
