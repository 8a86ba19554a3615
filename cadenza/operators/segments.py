"""Cutting sources into segments: a fold that keeps cuts far enough apart, splitting of long stretches, start times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MIN_LENGTH = 4.0
MAX_LENGTH = 24.0
FALLBACK_LENGTH = 6.0
DEGENERATE = 0.05
#: Seconds of a source that one task cuts at a time.
BLOCK_SECONDS = 4096.0


def kept_cuts(cuts: Column, duration: Column, least: float = MIN_LENGTH) -> Column:
    """Cuts (ascending) at least `least` after the last cut that was kept, and before the end."""
    start = F.struct(F.lit(0.0).alias("prev"), F.array().cast("array<double>").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        fits = (t > 0) & (t < duration) & (t - acc["prev"] >= least) & (duration - t >= least)
        return F.when(fits, F.struct(t.alias("prev"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc)

    return F.aggregate(cuts, start, step, lambda acc: acc["kept"])


def fallback_cuts(cuts: Column, duration: Column, length: float = FALLBACK_LENGTH) -> Column:
    """Even cuts where none were found."""
    n = F.ceil(duration / F.lit(length)).cast("int") - 1
    even = F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i * F.lit(length))).otherwise(F.array().cast("array<double>"))
    return F.when(F.size(cuts) == 0, even).otherwise(cuts)


def _stretch(a: Column, b: Column, duration: Column, most: float) -> Column:
    """The boundaries after a up to b: floor(span / most) even ones if the span is longer than `most`, and b unless it is the end."""
    none = F.array().cast("array<double>")
    q = F.floor((b - a) / F.lit(most)).cast("int")
    inner = F.when(b - a > most, F.transform(F.sequence(F.lit(1), F.greatest(q, F.lit(1))), lambda j: F.round(a + (b - a) / (q + 1) * j, 3))).otherwise(none)
    return F.concat(inner, F.when(b < duration, F.array(F.round(b, 3))).otherwise(none))


def split_cuts(kept: Column, duration: Column, most: float = MAX_LENGTH) -> Column:
    """The kept cuts and, in stretches longer than `most`, floor(span / most) more at even distances; rounded, distinct, ascending."""
    ends = F.concat(kept, F.array(duration))
    starts = F.concat(F.array(F.lit(0.0)), kept)
    return F.array_sort(F.array_distinct(F.flatten(F.zip_with(starts, ends, lambda a, b: _stretch(a, b, duration, most)))))


def boundary_plan(sources: DataFrame, fallback: float = FALLBACK_LENGTH) -> DataFrame:
    """kept: the cuts that stay (even ones where no scene cut was found at all); boundaries: those and the ones in long stretches."""
    cuts = fallback_cuts(F.col("cuts"), F.col("duration"), fallback)
    kept = sources.withColumn("kept", kept_cuts(cuts, F.col("duration")))
    return kept.withColumn("boundaries", split_cuts(F.col("kept"), F.col("duration")))


def pieces(plan: DataFrame) -> DataFrame:
    """A row per piece between boundaries: source, file (its place) and duration."""
    edges = F.concat(F.array(F.lit(0.0)), F.col("boundaries"), F.array(F.col("duration")))
    spans = F.transform(F.slice(edges, 1, F.size("boundaries") + 1), lambda e, i: F.round(F.get(edges, i + 1) - e, 3))
    return plan.select("source", F.posexplode(spans).alias("file", "length"))


def segment_starts(cut: DataFrame, degenerate: float = DEGENERATE) -> DataFrame:
    """Pieces longer than `degenerate`, numbered, each starting where the kept ones before it end."""
    order = W.partitionBy("source").orderBy("file")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return cut.where(F.col("length") > degenerate).select("source", (F.row_number().over(order) - 1).cast("int").alias("idx"), F.round(before, 3).alias("start"), F.col("length").alias("duration"))


def side_by_side(cut: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Segments (source, idx and more) with the columns of the others at the same source and idx. The lists of a source must all be of
    one length and numbered alike: a place that one of them lacks, or has alone, is an error when it is read."""
    out = cut.withColumn("__in_cut", F.lit(True))
    for name, other in others.items():
        out = out.join(other.withColumn(f"__in_{name}", F.lit(True)), ["source", "idx"], "full")
    marks = ["__in_cut", *(f"__in_{n}" for n in others)]
    said = F.concat(F.lit("lists of unequal length at "), F.col("source").cast("string"), F.lit(" "), F.col("idx").cast("string"))
    whole = F.when(F.array_compact(F.array(*marks)).isNotNull() & (F.size(F.array_compact(F.array(*marks))) == len(marks)), F.col("idx")).otherwise(F.raise_error(said).cast("int"))
    return out.withColumn("idx", whole).drop(*marks)


def all_there(segments: DataFrame, files: DataFrame) -> DataFrame:
    """segments (path and more); reading one whose file (path, length) does not exist or is empty is an error."""
    met = segments.join(files.where("length > 0").select("path", F.lit(True).alias("__there")).distinct(), "path", "left")
    said = F.concat(F.lit("missing or empty: "), F.col("path"))
    return met.withColumn("path", F.when(F.col("__there"), F.col("path")).otherwise(F.raise_error(said).cast("string"))).drop("__there").select(*segments.columns)


def concat_list(segments: DataFrame) -> DataFrame:
    """For each source the lines of a concat list in order of the segments."""
    from cadenza.functions.text import concat_line

    path = concat_line(F.concat(F.lit("/work/src'"), F.col("source").cast("string"), F.lit("_"), F.lpad(F.col("idx").cast("string"), 4, "0"), F.lit(".mkv")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", path.alias("line")))), lambda s: s["line"])
    return segments.groupBy("source").agg(F.array_join(lines, "\n").alias("listing"), F.round(F.sum("duration"), 3).alias("total"))


def _spaced(cuts: Column, before: Column, least: float) -> Column:
    """Those of cuts (ascending) that are kept if the last one kept before them is at before."""
    start = F.struct(before.alias("prev"), F.array().cast("array<double>").alias("kept"))
    step = lambda acc, t: F.when(t - acc["prev"] >= least, F.struct(t.alias("prev"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc)
    return F.aggregate(cuts, start, step, lambda acc: acc["kept"])


def boundary_rows(cuts: DataFrame, sources: DataFrame, least: float = MIN_LENGTH, most: float = MAX_LENGTH, fallback: float = FALLBACK_LENGTH, width: float = BLOCK_SECONDS) -> DataFrame:
    """boundary_plan for sources of any number of cuts: source and boundary, a row each, from cuts (source, t: distinct) and sources (source, duration).

    Whether a cut stays hangs on the last one kept before it, but only through the first cut kept in its block of `width` seconds, and that is one of
    those in the block's first `least` seconds or the next: so a block is summed up as a few pairs (first cut kept, last cut kept). One pass
    over a source's pairs tells what each block begins with, and then all blocks are cut at once. Tasks hold blocks, and one array of a few
    numbers for each block of a source.
    """
    none = sources.join(cuts.select("source").distinct(), "source", "left_anti")
    even = none.select("source", F.explode(fallback_cuts(F.array().cast("array<double>"), F.col("duration"), fallback)).alias("t"))
    inside = (F.col("t") > 0) & (F.col("t") < F.col("duration")) & (F.col("duration") - F.col("t") >= least)
    found = cuts.select("source", "t").unionByName(even).join(sources.select("source", "duration"), "source").where(inside)
    blocks = found.groupBy("source", F.floor(F.col("t") / F.lit(width)).alias("block")).agg(F.array_sort(F.collect_list("t")).alias("cuts"), F.max("duration").alias("duration"))
    head = F.col("block") * F.lit(width) + least
    firsts = F.concat(F.filter("cuts", lambda t: t < head), F.slice(F.filter("cuts", lambda t: t >= head), 1, 1))
    last = lambda f: F.aggregate("cuts", f, lambda p, t: F.when(t - p >= least, t).otherwise(p))
    pairs = F.transform(firsts, lambda f: F.struct(f.alias("first"), last(f).alias("last")))
    per = blocks.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("block", pairs.alias("pairs")))).alias("maps"))

    def pass_on(acc: Column, m: Column) -> Column:
        hit = F.try_element_at(F.filter(m["pairs"], lambda p: p["first"] - acc["prev"] >= least), F.lit(1))
        return F.struct(F.coalesce(hit["last"], acc["prev"]).alias("prev"), F.concat(acc["out"], F.array(F.struct(m["block"].alias("block"), acc["prev"].alias("before")))).alias("out"))

    start = F.struct(F.lit(0.0).alias("prev"), F.array().cast("array<struct<block:bigint,before:double>>").alias("out"))
    passed = per.select("source", F.aggregate("maps", start, pass_on).alias("p"))
    entered = passed.select("source", F.explode("p.out").alias("e")).select("source", "e.*")
    kept = blocks.join(entered, ["source", "block"]).withColumn("kept", _spaced(F.col("cuts"), F.col("before"), least))
    spans = F.zip_with(F.concat(F.array("before"), F.slice("kept", 1, F.greatest(F.size("kept") - 1, F.lit(0)))), "kept", lambda a, b: _stretch(a, b, F.col("duration"), most))
    within = kept.where(F.size("kept") > 0).select("source", F.explode(F.flatten(spans)).alias("boundary"))
    ends = sources.join(passed.select("source", F.col("p.prev").alias("prev")), "source", "left")
    final = ends.select("source", F.explode(_stretch(F.coalesce("prev", F.lit(0.0)), F.col("duration"), F.col("duration"), most)).alias("boundary"))
    return within.unionByName(final).distinct()


def segment_rows(boundaries: DataFrame, sources: DataFrame, degenerate: float = DEGENERATE, width: float = BLOCK_SECONDS) -> DataFrame:
    """pieces and segment_starts of boundary_rows: source, idx, start and duration. Differences, numbers and sums (of whole thousandths) run within
    blocks of `width` seconds; what comes before a block is added up over a row per block."""
    edges = boundaries.select("source", F.col("boundary").alias("stop")).unionByName(sources.select("source", F.col("duration").alias("stop")))
    placed = edges.withColumn("block", F.floor(F.col("stop") / F.lit(width)))
    inner, over = W.partitionBy("source", "block").orderBy("stop"), W.partitionBy("source").orderBy("block")
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    ends = placed.groupBy("source", "block").agg(F.max("stop").alias("last")).withColumn("reached", F.coalesce(F.lag("last").over(over), F.lit(0.0))).drop("last")
    length = F.round(F.col("stop") - F.coalesce("before", "reached"), 3)
    cut = placed.withColumn("before", F.lag("stop").over(inner)).join(ends, ["source", "block"]).withColumn("length", length).where(F.col("length") > degenerate)
    cut = cut.withColumn("ms", F.round(F.col("length") * 1000).cast("bigint"))
    sums = cut.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("held"))
    sums = sums.select("source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("ms_before"))
    out = cut.withColumns({"i": F.row_number().over(inner), "own": F.coalesce(F.sum("ms").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}).join(sums, ["source", "block"])
    return out.select("source", (F.col("n_before") + F.col("i") - 1).cast("int").alias("idx"), ((F.col("ms_before") + F.col("own")) / F.lit(1000.0)).alias("start"), F.col("length").alias("duration"))
