"""Designs: grids, neighbours, screens, samples of the parameter space, and the solver for the crf that meets a target."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions import params as P
from cadenza.operators import select
from cadenza.plans.rounds import kept, settled


def aq_grid(spaces: DataFrame, steps: int = 5) -> DataFrame:
    """Every AQ setting of every space, in order, without repeats that come of rounding."""
    s = P.space_columns()
    each = spaces.select("*", F.posexplode("aq_modes").alias("mode_at", "mode")).select("*", F.posexplode(P.strength_grid(s, steps)).alias("strength_at", "strength"))
    c = P.clamp(0.5 * (s["crf_min"] + s["crf_max"]), F.col("mode"), F.col("strength"), s)
    settings = each.select("encoder", "mode_at", "strength_at", c["aq_mode"].alias("aq_mode"), c["aq_strength"].alias("aq_strength"))
    first = W.partitionBy("encoder", "aq_mode", "aq_strength").orderBy("mode_at", "strength_at")
    kept = settings.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.withColumn("seq", F.row_number().over(W.partitionBy("encoder").orderBy("mode_at", "strength_at"))).drop("n")


def aq_neighbours(grid: DataFrame) -> DataFrame:
    """For each setting those one step away in mode or strength: mode before, after, strength before, after."""
    a = grid.select("encoder", F.col("mode_at").alias("m"), F.col("strength_at").alias("s"), "aq_mode", "aq_strength")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.lit(dm).alias("dm"), F.lit(ds).alias("ds")) for i, (dm, ds) in enumerate(((-1, 0), (1, 0), (0, -1), (0, 1)))]))
    asked = a.withColumn("step", steps).select("encoder", "aq_mode", "aq_strength", F.col("step.way").alias("way"), (F.col("m") + F.col("step.dm")).alias("m"), (F.col("s") + F.col("step.ds")).alias("s"))
    there = a.select("encoder", "m", "s", F.col("aq_mode").alias("next_mode"), F.col("aq_strength").alias("next_strength"))
    return asked.join(there, ["encoder", "m", "s"]).drop("m", "s")


def screen_plan(spaces: DataFrame, n_explore: int = 12, n_crfs: int = 2, steps: int = 5) -> DataFrame:
    """AQ settings by crf probes, about 2 max(8, n_explore) of them: first fewer probes, then every so many settings."""
    budget = 2 * max(8, n_explore)
    most = max(1, min(n_crfs, 4))
    s = P.space_columns()
    sized = aq_grid(spaces, steps).withColumn("total", F.count(F.lit(1)).over(W.partitionBy("encoder")))
    probes = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(budget) / F.col("total")).cast("int")))
    keep = F.when(F.col("total") * probes > budget, max(4, budget)).otherwise(F.col("total"))
    place = F.array_contains(F.transform(F.sequence(F.lit(0), keep.cast("int") - 1), lambda i: F.bround(i * (F.col("total") - 1) / F.greatest(keep - 1, F.lit(1)), 0).cast("int")), (F.col("seq") - 1).cast("int"))
    chosen = sized.withColumn("probes", probes).where(place | (keep >= F.col("total")))
    crfs = F.explode(F.filter(F.array(*[F.when(F.col("probes") == n, P.interior_crfs(s, n)) for n in range(1, most + 1)]), lambda a: a.isNotNull())[0])
    return chosen.join(spaces, "encoder").select("encoder", "aq_mode", "aq_strength", crfs.alias("crf"))


def grid_design(spaces: DataFrame, n: int = 16) -> DataFrame:
    """A regular grid of about n points: crf by mode by strength, without repeats, the first n."""
    s = P.space_columns()
    per = F.greatest(F.lit(2), F.bround(F.sqrt(F.lit(float(max(n, 4))) / F.size("aq_modes")), 0).cast("int"))
    line = lambda lo, hi: F.transform(F.sequence(F.lit(0), F.col("per") - 1), lambda i: lo + (hi - lo) * i / (F.col("per") - 1))
    each = spaces.withColumn("per", per).select("*", F.posexplode(line(s["crf_min"], s["crf_max"])).alias("i", "c")).select("*", F.posexplode("aq_modes").alias("j", "m")).select("*", F.posexplode(line(s["strength_min"], s["strength_max"])).alias("k", "a"))
    c = P.clamp(F.col("c"), F.col("m"), F.col("a"), s)
    return _first_of_each(each.select("encoder", F.struct("i", "j", "k").alias("at"), *[v.alias(k) for k, v in c.items()]), n)


def _first_of_each(points: DataFrame, n: int) -> DataFrame:
    """Of points with equal keys the first, and of those the first n of each encoder, numbered."""
    same = W.partitionBy("encoder", P.params_key(F.col("crf"), F.col("aq_mode"), F.col("aq_strength"))).orderBy("at")
    first = points.withColumn("d", F.row_number().over(same)).where("d = 1")
    return first.withColumn("seq", F.row_number().over(W.partitionBy("encoder").orderBy("at"))).where(F.col("seq") <= n).drop("at", "d")


#: Digits of a Halton point in each base: as many as make up about SOBOL_BITS bits.
HALTON_DIGITS = {2: 30, 3: 19, 5: 13}


def digit_orders(base: int, seed: int) -> list[list[int]]:
    """For each place after the point a permutation of the base's digits: their order by the MD5 of seed, base, place and digit."""
    drawn = lambda place, digit: hashlib.md5(f"{seed}:halton{base}:{place}:{digit}".encode()).hexdigest()
    orders = []
    for place in range(HALTON_DIGITS[base]):
        ranked = sorted(range(base), key=lambda d: (drawn(place, d), d))
        orders.append([ranked.index(d) for d in range(base)])
    return orders


def halton(i: Column, base: int, seed: int) -> Column:
    """The i-th point of a Halton axis: the digits of i in the base, each permuted as its place says, mirrored at the point. Sums are of
    whole numbers, so a point is exact."""
    orders, n = digit_orders(base, seed), HALTON_DIGITS[base]
    x = F.lit(0).cast("bigint")
    for place, order in enumerate(orders):
        digit = F.pmod(F.floor(i / F.lit(float(base**place))).cast("bigint"), F.lit(base)).cast("int")
        x = x + F.element_at(F.array(*[F.lit(v * base ** (n - 1 - place)).cast("bigint") for v in order]), digit + 1)
    return (x.cast("double") + 0.5) / F.lit(float(base**n))


#: Direction numbers of the first three Sobol axes, 30 bits each (fixed values; the first is the van der Corput sequence).
SOBOL_BITS = 30


def sobol_directions() -> list[list[int]]:
    """For each axis the number that bit j of a point's index adds (by exclusive or), from the primitive polynomials x + 1 and x^2 + x + 1."""
    axes = [[1 << (SOBOL_BITS - 1 - j) for j in range(SOBOL_BITS)]]
    for degree, inner, m in ((1, 0, [1]), (2, 1, [1, 3])):
        while len(m) < SOBOL_BITS:
            new = m[-degree] ^ (m[-degree] << degree)
            for i in range(1, degree):
                new ^= ((inner >> (degree - 1 - i)) & 1) * (m[-i] << i)
            m.append(new)
        axes.append([v << (SOBOL_BITS - 1 - j) for j, v in enumerate(m)])
    return axes


def draw(*parts: Column) -> Column:
    """A number from 0 to 1 that hangs on the parts alone: the first 13 hexadecimal digits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sobol(i: Column, axis: int, seed: int) -> Column:
    """The i-th point (from 0) of a Sobol axis, scrambled digit by digit: whether a binary digit is turned hangs on the seed and all digits
    before it (a nested uniform scramble, so every dyadic box keeps its points, and the error of means falls faster than by a shift)."""
    x = F.lit(0).cast("bigint")
    for j, v in enumerate(sobol_directions()[axis][:16]):
        x = x.bitwiseXOR(F.shiftright(i, j).bitwiseAND(1).cast("bigint") * F.lit(v))

    def turned(x: Column) -> Column:
        before = lambda k: F.floor(x / F.pow(F.lit(2.0), F.lit(SOBOL_BITS) - k)).cast("bigint")
        odd = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:sobol{axis}:"), k.cast("string"), F.lit(":"), before(k).cast("string"))), 1, 1), 16, 10).cast("bigint") % 2
        return F.aggregate(F.sequence(F.lit(0), F.lit(SOBOL_BITS - 1)), F.lit(0).cast("bigint"), lambda out, k: out * 2 + (before(k + 1) + odd(k)) % 2)

    return (F.transform(F.array(x), turned)[0].cast("double") + 0.5) / F.lit(float(1 << SOBOL_BITS))


def sampled_design(spaces: DataFrame, method: str = "sobol", n: int = 16, seed: int = 0) -> DataFrame:
    """n (65,536 at most) points of each space by a low-discrepancy or random method: sobol, halton, lhs (one point in each of n strata
    of every axis) or random. Sobol and Halton points are scrambled. All draws hang on the seed alone."""
    s = P.space_columns()
    points = spaces.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(n))))
    said = lambda *parts: draw(F.lit(str(seed)), *parts)
    each = lambda axis: said(F.col("encoder"), F.col("at").cast("string"), F.lit(str(axis)))
    if method == "sobol":
        u = [sobol(F.col("at") - 1, axis, seed) for axis in range(3)]
    elif method == "halton":
        u = [halton(F.col("at"), base, seed) for base in (2, 3, 5)]
    elif method == "lhs":
        stratum = lambda axis: F.row_number().over(W.partitionBy("encoder").orderBy(said(F.col("encoder"), F.col("at").cast("string"), F.lit(f"order{axis}")), "at")) - 1
        u = [(stratum(a) + each(a)) / F.lit(float(n)) for a in range(3)]
    elif method == "random":
        u = [each(a) for a in range(3)]
    else:
        raise ValueError(f"unknown method {method!r}: sobol, halton, lhs or random")
    placed = points.withColumns({"u0": u[0], "u1": u[1], "u2": u[2]})
    c = P.from_unit(F.col("u0"), F.col("u1"), F.col("u2"), s)
    return _first_of_each(placed.select("encoder", "at", *[v.alias(k) for k, v in c.items()]), n)


def synthetic_surface(proposals: DataFrame) -> DataFrame:
    """A measurement source: quality falls by one per crf, size linearly. Others have the same shape: rows in, vmaf and out_bytes added."""
    return proposals.withColumns({"vmaf": F.greatest(F.lit(0.0), 110.0 - F.col("crf")), "out_bytes": F.greatest(F.lit(1000), F.floor(400_000 - 2000 * F.col("crf"))).cast("bigint"), "ref_bytes": F.lit(1_000_000).cast("bigint")})


def narrow(brackets: DataFrame, measure=synthetic_surface, method: str = "secant", tolerance: float = 0.5, rounds: int = 6) -> tuple[DataFrame, list[DataFrame]]:
    """Narrows every bracket (rows of crf_bracket, and what else the source needs) at once, and returns the brackets as they end, and what was
    probed, a table for each round: the bracket's columns, crf and what was measured. method: secant, golden or brent, which carries
    the points of each bracket along.

    A round is about open brackets only: those with two ends farther apart than the tolerance. One is given up when its probe does not lie
    between its ends or can't be measured. Rounds are settled, so nothing is measured twice, and what is closed is not read again.
    """
    point = F.struct(F.col("crf").alias("crf"), F.col("vmaf").alias("vmaf"))
    ends_of = lambda end: F.struct(F.col(f"crf_{end}").alias("crf"), F.col(f"vmaf_{end}").alias("vmaf"))
    now = brackets.withColumn("history", F.array(ends_of("low"), ends_of("high"))) if method == "brent" else brackets
    names, wide = now.columns, F.coalesce(F.col("crf_high") - F.col("crf_low") > tolerance, F.lit(False))
    hold = kept if "segment_hash" in names else settled
    now = hold(now)
    closed, probes = [now.where(~wide).select(*brackets.columns)], []
    now = now.where(wide)
    for i in range(rounds):
        if i and now.isEmpty():
            break
        probed = hold(measure(select.with_guess(now, method).withColumn("crf", P.rounded_crf(F.col("guess"))).drop("guess")))
        probes.append(probed)
        useful = F.coalesce(F.col("vmaf").isNotNull() & (F.col("crf") > F.col("crf_low")) & (F.col("crf") < F.col("crf_high")), F.lit(False))
        closed.append(probed.where(~useful).select(*brackets.columns))
        meets = F.col("vmaf") >= F.col("target")
        new = {"crf_low": (meets, "crf"), "vmaf_low": (meets, "vmaf"), "crf_high": (~meets, "crf"), "vmaf_high": (~meets, "vmaf")}
        moved = {c: F.when(side, F.col(v)).otherwise(F.col(c)) for c, (side, v) in new.items()}
        if method == "brent":
            moved["history"] = F.concat("history", F.array(point))
        now = probed.where(useful).select(*[moved[c].alias(c) if c in moved else c for c in names])
        closed.append(now.where(~wide).select(*brackets.columns))
        now = now.where(wide)
    closed.append(now.select(*brackets.columns))
    return reduce(DataFrame.unionAll, closed), probes


def solve_crf(brackets: DataFrame, measure=synthetic_surface, method: str = "secant", tolerance: float = 0.5, rounds: int = 6) -> DataFrame:
    """The brackets as narrow leaves them. Rows with only one end come back as they are."""
    return narrow(brackets, measure, method, tolerance, rounds)[0]
