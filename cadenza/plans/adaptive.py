"""Search strategies that go by what was measured before.

bayes, tpe and cmaes propose each segment's next trials from its former ones, for one target; coordinate and boundary
walk over the grid of AQ settings, for every target. Each round proposes for all segments together and measures what it
proposed; a segment's history is a bounded array (as many trials as the search may make), so no task gathers more than that.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions import params as P
from cadenza.functions import scoring
from cadenza.operators import select
from cadenza.plans import design
from cadenza.plans.rounds import SEQ, Measure, dealt, grown, kept, measured, rate, rated

AXES = ("crf_u", "mode_u", "strength_u")
#: Share of the trials that count as good, and the least spread of good and bad ones.
GAMMA, SPREAD = 0.25, 0.08
#: Weight of a candidate's uncertainty against its chance of meeting the target.
CURIOSITY = 0.15
#: Length scales and noise levels among which a Gaussian process chooses by its evidence.
LENGTHS, NOISES = (0.15, 0.3, 0.6, 1.2), (1e-4, 1e-2, 0.1, 0.5)
#: Segments whose processes are factored together.
BATCH = 256
#: Offspring of a generation, parents kept, tries for each offspring.
OFFSPRING, PARENTS, TRIES = 4, 2, 4

Solve = Callable[[DataFrame, DataFrame], DataFrame]


def _key(c: Column | None = None) -> Column:
    get = F.col if c is None else c.getField
    return P.params_key(get("crf"), get("aq_mode"), get("aq_strength"))


def placed(trials: DataFrame, spaces: DataFrame, target: float) -> DataFrame:
    """trials with their places in the unit cube, their fitness (the ranking proxy) and their keys."""
    u = P.to_unit(F.col("crf"), F.col("aq_mode"), F.col("aq_strength"), P.space_columns())
    inside = trials.join(F.broadcast(spaces), "encoder")  # a row per encoder
    return inside.select("segment_hash", "encoder", *SEQ, "vmaf", *[u[a].alias(a) for a in AXES], scoring.proxy(F.col("vmaf"), rate(), F.lit(float(target))).alias("fitness"), _key().alias("key"))


def candidates(spaces: DataFrame, seed: int, n: int = 96, sampler: str = "halton") -> DataFrame:
    """pool: per encoder n points of the sampler and half as many random ones, each with its key; a point that both have is there once."""
    both = design.sampled_design(spaces, sampler, n, seed).unionByName(design.sampled_design(spaces, "random", n // 2, seed).withColumn("seq", F.col("seq") + n))
    first = W.partitionBy("encoder", "key").orderBy("seq")
    once = both.withColumn("key", _key()).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    u = P.to_unit(F.col("crf"), F.col("aq_mode"), F.col("aq_strength"), P.space_columns())
    point = F.struct("seq", *[u[a].alias(a) for a in AXES], "crf", "aq_mode", "aq_strength", "key")
    return once.join(F.broadcast(spaces), "encoder").groupBy("encoder").agg(F.array_sort(F.collect_list(point)).alias("pool"))


def pools(spaces: DataFrame, seed: int, sampler: str = "halton") -> dict[str, list]:
    """Per encoder its candidates (a hundred or two), which every task needs whole: they go along with its function, not with each segment."""
    return {r["encoder"]: r["pool"] for r in candidates(spaces, seed, sampler=sampler).collect()}


def _cube(points: list) -> np.ndarray:
    return np.array([[p[a] for a in AXES] for p in points]).reshape(-1, 3)


def unseen(pool: list, seen: pd.Series) -> np.ndarray:
    """For each segment (its keys seen) which of the pool's candidates are new to it."""
    at = {p["key"]: i for i, p in enumerate(pool)}
    out = np.ones((len(seen), len(pool)), bool)
    for row, keys in zip(out, seen, strict=True):
        row[[at[k] for k in keys if k in at]] = False
    return out


def chosen(history: DataFrame, pool: dict[str, list], pick: Column) -> DataFrame:
    """history (a row per segment) with point, the candidate of its encoder that pick, a number from 0, tells; without those of no pick."""
    kind = "encoder string, pool array<struct<seq int, crf_u double, mode_u double, strength_u double, crf double, aq_mode int, aq_strength double, key string>>"
    table = history.sparkSession.createDataFrame([(e, [tuple(p) for p in points]) for e, points in pool.items()], kind)
    picked = history.withColumn("__i", pick).where("__i IS NOT NULL").select("segment_hash", "encoder", "__i")
    return picked.join(F.broadcast(table), "encoder").select("segment_hash", "encoder", F.element_at("pool", F.col("__i") + 1).alias("point"))  # a row per encoder


def log_ratios(cube: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """For each segment and candidate the log density among the good trials less that among the bad: good and bad hold, per axis, mean, spread and
    twice the spread's logarithm (segments, 9)."""
    sides = []
    for side in (good, bad):
        total = np.zeros((len(side), len(cube)))
        for i in range(3):
            z = (cube[None, :, i] - side[:, 3 * i, None]) / side[:, 3 * i + 1, None]
            total += z * z + side[:, 3 * i + 2, None]
        sides.append(-0.5 * total)
    return sides[0] - sides[1]


def propose_tpe(at: DataFrame, spaces: DataFrame, target: float, seed: int, sampler: str = "halton") -> DataFrame:
    """The candidate that is likeliest among the good trials against the bad ones, each a Gaussian without correlations."""
    part = W.partitionBy("segment_hash")
    n_good = F.greatest(F.lit(2), F.ceil(GAMMA * F.col("n")).cast("int"))
    ranked = at.withColumns({"place": F.row_number().over(part.orderBy(F.desc("fitness"), *SEQ)), "n": F.count(F.lit(1)).over(part)}).where("n >= 4")
    good = F.col("place") <= n_good
    bad = F.when(F.col("n") > n_good, ~good).otherwise(F.col("place") > F.col("n") - 2)
    stats = [f for side, name in ((good, "good"), (bad, "bad")) for a in AXES for f in (F.avg(F.when(side, F.col(a))).alias(f"{name}_mean_{a}"), F.greatest(F.stddev_pop(F.when(side, F.col(a))), F.lit(SPREAD)).alias(f"{name}_std_{a}"))]
    history = ranked.groupBy("segment_hash", "encoder").agg(F.collect_set("key").alias("seen"), *stats)
    pool = pools(spaces, seed, sampler)
    cubes = {e: _cube(points) for e, points in pool.items()}

    @F.pandas_udf("int")
    def pick(encoder: pd.Series, seen: pd.Series, *sides: pd.Series) -> pd.Series:
        numbers = np.stack([c.to_numpy(float) for c in sides], axis=1)
        out = pd.array([None] * len(seen), dtype="Int32")
        for e, points in pool.items():
            mine = np.flatnonzero((encoder == e).to_numpy())
            for s in range(0, len(mine), BATCH):
                some = mine[s : s + BATCH]
                new = unseen(points, seen.iloc[some])
                ratio = np.where(new, log_ratios(cubes[e], numbers[some, :9], numbers[some, 9:]), -np.inf)
                left = new.any(axis=1)
                out[some[left]] = ratio[left].argmax(axis=1)  # of equals the first: the pool is in its order
        return pd.Series(out)

    sides = [f(F.col(f"{name}_{k}_{a}")) for name in ("good", "bad") for a in AXES for k, f in (("mean", lambda c: c), ("std", lambda c: c), ("std", lambda c: 2.0 * F.log(c)))]
    return chosen(history, pool, pick("encoder", "seen", *sides))


def matern(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    """The Matern kernel of smoothness 5/2."""
    d = math.sqrt(5.0) * np.linalg.norm(a[:, None] - b[None], axis=2) / length
    return (1 + d + d * d / 3) * np.exp(-d)


def posterior(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread, at the given points, of a Gaussian process through (x, y) whose scales have the highest evidence."""
    middle, unit = y.mean(), y.std() or 1.0
    z = (y - middle) / unit
    best = None
    for length in LENGTHS:
        for noise in NOISES:
            root = np.linalg.cholesky(matern(x, x, length) + (noise + 1e-8) * np.eye(len(x)))
            half = np.linalg.solve(root, z)
            evidence = -0.5 * half @ half - np.log(np.diag(root)).sum()
            if best is None or evidence > best[0]:
                best = evidence, length, root, half
    _, length, root, half = best
    across = np.linalg.solve(root, matern(x, at, length))
    return middle + unit * (across.T @ half), unit * np.sqrt(np.maximum(1.0 - (across**2).sum(axis=0), 1e-12))


def acquisition(x: np.ndarray, y: np.ndarray, at: np.ndarray, target: float) -> np.ndarray:
    """The chance that a point meets the target, times its crf in the unit cube, and some of its uncertainty."""
    mean, spread = posterior(x, y, at)
    spread = np.maximum(spread, 1e-6)
    chance = np.array([0.5 * (1.0 + math.erf(v)) for v in (mean - target) / spread / math.sqrt(2.0)])
    return chance * at[:, 0] + CURIOSITY * spread / (spread.max() + 1e-6)


def batch_acquisition(x: np.ndarray, y: np.ndarray, at: np.ndarray, target: float) -> np.ndarray:
    """acquisition for many segments with as many trials each: x (segments, trials, 3), y (segments, trials), at (segments, points, 3). All
    factors of a scale are found in one call, and each segment keeps the scales of its highest evidence."""
    apart = lambda a, b: np.sqrt(np.maximum(((a[:, :, None] - b[:, None]) ** 2).sum(axis=3), 0.0))
    kernel = lambda d, length: (lambda r: (1 + r + r * r / 3) * np.exp(-r))(math.sqrt(5.0) * d / length)
    middle, unit = y.mean(axis=1, keepdims=True), y.std(axis=1, keepdims=True)
    unit = np.where(unit > 0, unit, 1.0)
    z, own = ((y - middle) / unit)[:, :, None], apart(x, x)
    best, scale = np.full(len(x), -np.inf), np.ones(len(x))
    root, half = np.empty_like(own), np.empty_like(z)
    for length in LENGTHS:
        k = kernel(own, length)
        for noise in NOISES:
            r = np.linalg.cholesky(k + (noise + 1e-8) * np.eye(x.shape[1]))
            h = np.linalg.solve(r, z)
            evidence = -0.5 * (h**2).sum(axis=(1, 2)) - np.log(np.diagonal(r, axis1=1, axis2=2)).sum(axis=1)
            better = evidence > best
            best[better], scale[better], root[better], half[better] = evidence[better], length, r[better], h[better]
    across = np.linalg.solve(root, kernel(apart(x, at), scale[:, None, None]))
    mean = middle + unit * (across * half).sum(axis=1)
    spread = np.maximum(unit * np.sqrt(np.maximum(1.0 - (across**2).sum(axis=1), 1e-12)), 1e-6)
    chance = 0.5 * (1.0 + _erf((mean - target) / spread / math.sqrt(2.0)).astype(float))
    return chance * at[:, :, 0] + CURIOSITY * spread / (spread.max(axis=1, keepdims=True) + 1e-6)


_erf = np.frompyfunc(math.erf, 1, 1)


def batch_picks(xs: list[np.ndarray], ys: list[np.ndarray], pools: list[np.ndarray], target: float) -> np.ndarray:
    """For each segment the place in its pool with the highest acquisition (of equals the first), by batches of segments with as many
    trials. Pools are made as long as the longest of a batch by their last points, which never come before themselves."""
    out = np.zeros(len(xs), dtype=np.int32)
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(xs):
        groups.setdefault(len(x), []).append(i)
    for members in groups.values():
        for s in range(0, len(members), BATCH):
            some = members[s : s + BATCH]
            longest = max(len(pools[i]) for i in some)
            at = np.stack([np.concatenate([pools[i], np.repeat(pools[i][-1:], longest - len(pools[i]), axis=0)]) for i in some])
            out[some] = batch_acquisition(np.stack([xs[i] for i in some]), np.stack([ys[i] for i in some]), at, target).argmax(axis=1)
    return out


def pool_picks(xs: list[np.ndarray], ys: list[np.ndarray], pool: np.ndarray, new: np.ndarray, target: float) -> np.ndarray:
    """For each segment the place in the pool with the highest acquisition among its new candidates (of equals the first), -1 without any.

    Segments that tried the same points share the factors of every scale and the points' spreads; each keeps the scale of its highest evidence."""
    out = np.full(len(xs), -1, dtype=np.int32)
    groups: dict[bytes, list[int]] = {}
    for i, x in enumerate(xs):
        groups.setdefault(x.tobytes(), []).append(i)
    sizes: dict[int, list[list[int]]] = {}
    for members in groups.values():
        sizes.setdefault(len(xs[members[0]]), []).append(members)
    for same in sizes.values():
        for s in range(0, len(same), BATCH):
            some = same[s : s + BATCH]
            scales = Scales(np.stack([xs[m[0]] for m in some]), pool)
            who = [(g, i) for g, members in enumerate(some) for i in members]
            for a in range(0, len(who), BATCH):
                of, rows = (np.array(c) for c in zip(*who[a : a + BATCH], strict=True))
                values = np.where(new[rows], scales.acquisition(of, np.stack([ys[i] for i in rows]), target, new[rows]), -np.inf)
                out[rows] = np.where(new[rows].any(axis=1), values.argmax(axis=1), -1)
    return out


class Scales:
    """The processes of every length and noise over some sets of points x (sets, trials, 3), met by a pool of candidates (candidates, 3)."""

    def __init__(self, x: np.ndarray, pool: np.ndarray) -> None:
        apart = lambda a, b: np.sqrt(np.maximum(((a[:, :, None] - b[:, None]) ** 2).sum(axis=3), 0.0))
        self.pool, self.own, self.across = pool, apart(x, x), apart(x, pool[None])
        self.inverse, self.weight = [], []  # of the root, and the sum of the logarithms on its diagonal
        for length in LENGTHS:
            k = self.kernel(self.own, length)
            for noise in NOISES:
                root = np.linalg.cholesky(k + (noise + 1e-8) * np.eye(x.shape[1]))
                self.inverse.append(np.linalg.inv(root))
                self.weight.append(np.log(np.diagonal(root, axis1=1, axis2=2)).sum(axis=1))

    @staticmethod
    def kernel(d: np.ndarray, length: float) -> np.ndarray:
        r = math.sqrt(5.0) * d / length
        return (1 + r + r * r / 3) * np.exp(-r)

    def acquisition(self, of: np.ndarray, y: np.ndarray, target: float, new: np.ndarray) -> np.ndarray:
        """acquisition of the whole pool for segments of the sets of, with qualities y (segments, trials) and new candidates."""
        middle, unit = y.mean(axis=1, keepdims=True), y.std(axis=1, keepdims=True)
        unit = np.where(unit > 0, unit, 1.0)
        z = ((y - middle) / unit)[:, :, None]
        best, scale, half = np.full(len(y), -np.inf), np.zeros(len(y), int), np.empty_like(z)
        for i, (inverse, weight) in enumerate(zip(self.inverse, self.weight, strict=True)):
            h = inverse[of] @ z
            evidence = -0.5 * (h**2).sum(axis=(1, 2)) - weight[of]
            better = evidence > best
            best[better], scale[better], half[better] = evidence[better], i, h[better]
        pairs, place = np.unique(np.stack([of, scale], axis=1), axis=0, return_inverse=True)
        shared = np.empty((len(pairs), self.own.shape[1], len(self.pool)))
        for i in np.unique(pairs[:, 1]):
            mine = pairs[:, 1] == i
            sets = pairs[mine, 0]
            shared[mine] = self.inverse[i][sets] @ self.kernel(self.across[sets], LENGTHS[i // len(NOISES)])
        width = np.sqrt(np.maximum(1.0 - (shared**2).sum(axis=1), 1e-12))
        place = place.ravel()
        mean = middle + unit * (half.transpose(0, 2, 1) @ shared[place])[:, 0]
        spread = np.maximum(unit * width[place], 1e-6)
        widest = np.where(new, spread, 0.0).max(axis=1, keepdims=True)
        chance = 0.5 * (1.0 + _erf((mean - target) / spread / math.sqrt(2.0)).astype(float))
        return chance * self.pool[None, :, 0] + CURIOSITY * spread / (widest + 1e-6)


def propose_bayes(at: DataFrame, spaces: DataFrame, target: float, seed: int, sampler: str = "halton") -> DataFrame:
    """The candidate with the highest acquisition by a Gaussian process over the segment's trials."""
    pool = pools(spaces, seed, sampler)
    cubes = {e: _cube(points) for e, points in pool.items()}

    @F.pandas_udf("int")
    def pick(encoder: pd.Series, seen: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.array([None] * len(seen), dtype="Int32")
        for e, points in pool.items():
            mine = np.flatnonzero((encoder == e).to_numpy())
            if len(mine):
                got = pool_picks([np.asarray(x.iloc[i], float).reshape(-1, 3) for i in mine], [np.asarray(y.iloc[i], float) for i in mine], cubes[e], unseen(points, seen.iloc[mine]), target)
                out[mine[got >= 0]] = got[got >= 0]
        return pd.Series(out)

    flat = F.flatten(F.transform("points", lambda p: F.array(*[p[a] for a in AXES])))
    history = at.groupBy("segment_hash", "encoder").agg(F.collect_set("key").alias("seen"), F.array_sort(F.collect_list(F.struct(*SEQ, *AXES, "vmaf"))).alias("points"))
    return chosen(history, pool, pick("encoder", "seen", flat, F.transform("points", lambda p: p["vmaf"])))


PROPOSE = {"bayes": propose_bayes, "tpe": propose_tpe}


def explore(segments: DataFrame, spaces: DataFrame, measure: Measure, model: str, target: float, n: int = 12, seed: int = 0, n_first: int = 0, sampler: str = "sobol") -> DataFrame:
    """About n trials of every segment: a design of the first n_first (half of them where that is 0), then what the model (bayes, tpe or
    cmaes) proposes. The sampler draws the first trials and the pools of candidates."""
    n = max(4, n)
    first = min(n, max(4, n_first or n // 2)) if model in PROPOSE else 4
    start = dealt(segments.select("segment_hash", "encoder")).join(F.broadcast(design.sampled_design(spaces, sampler, first, seed)), "encoder")
    trials = measured(measure, start.withColumn("stage", F.lit(0)))
    if model == "cmaes":
        return _evolve(trials, spaces, measure, target, n, seed)
    for i in range(1, n - first + 1):
        proposed = PROPOSE[model](placed(trials, spaces, target), spaces, target, seed + i, sampler)
        asked = proposed.select("segment_hash", "encoder", *[F.col(f"point.{c}").alias(c) for c in ("crf", "aq_mode", "aq_strength")], F.lit(0).alias("stage"), F.lit(1000 + i).alias("seq"))
        trials = grown(trials, measure(asked))
    return trials


def normal(*key: Column) -> Column:
    """A standard normal number drawn by the hash of a key."""
    u = [(F.pmod(F.xxhash64(*key, F.lit(side)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40)) for side in ("radius", "angle")]
    return F.sqrt(-2.0 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def _evolve(trials: DataFrame, spaces: DataFrame, measure: Measure, target: float, n: int, seed: int) -> DataFrame:
    """An evolution strategy: each generation draws OFFSPRING points about a mean and moves it to the PARENTS best of them."""
    s = P.space_columns()
    means, spreads = ([f"{p}_{a}" for a in AXES] for p in ("mean", "spread"))
    best = lambda c: F.max_by(c, F.struct("fitness", (-F.col("stage")).alias("s"), (-F.col("seq")).alias("q")))
    state = kept(placed(trials, spaces, target).groupBy("segment_hash", "encoder").agg(F.collect_set("key").alias("seen"), *[best(a).alias(m) for a, m in zip(AXES, means, strict=True)]).withColumns({c: F.lit(1.0) for c in spreads}))
    sigma = 0.22
    for generation in range(1, math.ceil((n - 4) / OFFSPRING) + 1):
        tries = state.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(OFFSPRING * TRIES)))).join(F.broadcast(spaces), "encoder")
        unit = {a: F.least(F.greatest(F.col(m) + sigma * F.col(d) * normal(F.lit(seed), "segment_hash", F.lit(generation), "i", F.lit(a)), F.lit(0.0)), F.lit(0.999)) for a, m, d in zip(AXES, means, spreads, strict=True)}
        drawn = tries.withColumns(unit).withColumns(P.from_unit(*[F.col(a) for a in AXES], s)).drop(*s).withColumn("key", _key()).where(~F.array_contains("seen", F.col("key")))
        fresh = drawn.withColumn("same", F.row_number().over(W.partitionBy("segment_hash", "key").orderBy("i"))).where("same = 1")
        taken = fresh.withColumn("nth", F.row_number().over(W.partitionBy("segment_hash").orderBy("i"))).where(F.col("nth") <= F.least(F.lit(OFFSPRING), n - F.size("seen")))
        asked = taken.drop("same", "nth").withColumns({"stage": F.lit(0), "seq": 1000 * generation + F.col("i")})
        born = kept(measure(asked).where("vmaf IS NOT NULL").withColumn("fitness", scoring.proxy(F.col("vmaf"), rate(), F.lit(float(target)))))
        trials = grown(trials, born)
        ranked = born.withColumn("place", F.row_number().over(W.partitionBy("segment_hash").orderBy(F.desc("fitness"), "seq")))
        parent = F.when(F.col("place") <= PARENTS, math.log(PARENTS + 0.5) - F.log(F.col("place").cast("double")))
        moved = [(0.8 * F.sum(parent * F.col(a)) / F.sum(parent) + 0.2 * F.first(m)).alias(m) for a, m in zip(AXES, means, strict=True)]
        widened = [(0.8 * F.first(d) + 0.2 * F.greatest(F.stddev_pop(F.when(parent.isNotNull(), F.col(a))), F.lit(0.05))).alias(d) for a, d in zip(AXES, spreads, strict=True)]
        state = kept(ranked.groupBy("segment_hash", "encoder").agg(F.array_union(F.first("seen"), F.collect_set("key")).alias("seen"), *moved, *widened))
        sigma = max(0.04, min(0.4, 0.95 * sigma))
    return trials


_AT = ["segment_hash", "target"]
_SETTING = ["aq_mode", "aq_strength"]


def neighbours(current: DataFrame, spaces: DataFrame, steps: int = 5) -> DataFrame:
    """The settings next to each current one (segment_hash, encoder, target, aq_mode, aq_strength), from the nearest of the grid."""
    grid = design.aq_grid(spaces, steps)
    near = grid.select("encoder", F.struct("aq_mode", "aq_strength", "mode_at", "strength_at").alias("g"))
    apart = F.struct(F.abs(F.col("g.aq_mode") - F.col("aq_mode")), F.abs(F.col("g.aq_strength") - F.col("aq_strength")), F.col("g.mode_at"), F.col("g.strength_at"))
    on_grid = current.join(F.broadcast(near), "encoder").groupBy(*_AT, "encoder").agg(F.min_by("g", apart).alias("g")).select(*_AT, "encoder", "g.aq_mode", "g.aq_strength")
    return on_grid.join(F.broadcast(design.aq_neighbours(grid)), ["encoder", *_SETTING]).select(*_AT, "encoder", F.col("next_mode").alias("aq_mode"), F.col("next_strength").alias("aq_strength"), "way")


def walk_boundary(trials: DataFrame, spaces: DataFrame, targets: DataFrame, measure: Measure, solve: Solve, rounds: int = 4) -> DataFrame:
    """Solves the crf at the best setting and at all its neighbours, moves to the best of what is known, until nothing moves.

    Where a round measured nothing of a segment nothing can move: later rounds rank the trials of the other segments only."""
    visited, before, active = None, None, trials
    for i in range(1, rounds + 1):
        current = kept(select.best_aq(rated(active, targets), SEQ).select(*_AT, "encoder", *_SETTING))
        moved = current if before is None else current.join(before, [*_AT, *_SETTING], "left_anti")
        hood = moved.unionByName(neighbours(moved, spaces).drop("way")).distinct()
        if visited is not None:
            hood = hood.join(visited, [*_AT, *_SETTING], "left_anti")
        hood = kept(hood)
        if hood.isEmpty():
            break
        seen = hood.select(*_AT, *_SETTING)
        visited, before = seen if visited is None else visited.unionByName(seen), current
        trials = grown(trials, solve(trials, hood).withColumn("stage", F.lit(i)))
        active = trials.join(hood.select("segment_hash").distinct(), "segment_hash", "left_semi")
    return trials


def walk_coordinate(trials: DataFrame, spaces: DataFrame, targets: DataFrame, measure: Measure, solve: Solve, rounds: int = 4) -> DataFrame:
    """Solves the crf at the first setting of the ranking, tries its neighbours at that crf and moves to the best if it is better."""
    first = rated(trials, targets).select("segment_hash", "encoder").distinct()
    current = select.rank_aq(rated(trials, targets), 1, SEQ).select(*_AT, *_SETTING).join(first, "segment_hash")
    visited = None
    for i in range(1, rounds + 1):
        if visited is not None:
            current = current.join(visited, [*_AT, *_SETTING], "left_anti")
        current = kept(current)
        if current.isEmpty():
            break
        seen = current.select(*_AT, *_SETTING)
        visited = seen if visited is None else visited.unionByName(seen)
        trials = grown(trials, solve(trials, current).withColumn("stage", F.lit(2 * i)))
        here = select.scored(rated(trials, targets)).join(seen, [*_AT, *_SETTING], "left_semi")
        order = W.partitionBy(*_AT).orderBy(F.desc("proxy"), *SEQ)
        held = kept(here.withColumn("n", F.row_number().over(order)).where("n = 1").select(*_AT, "crf", F.col("proxy").alias("held")))
        asked = neighbours(current, spaces).join(held, _AT).withColumns({"stage": F.lit(2 * i + 1), "seq": F.col("target").cast("int") * 10 + F.col("way")})
        tried = kept(measure(asked).where("vmaf IS NOT NULL"))
        trials = grown(trials, tried)
        better = tried.withColumn("proxy", scoring.proxy(F.col("vmaf"), rate(), F.col("target"))).where("proxy > held")
        current = better.withColumn("n", F.row_number().over(W.partitionBy(*_AT).orderBy(F.desc("proxy"), "way"))).where("n = 1").select(*_AT, *_SETTING, "encoder")
    return trials


WALKS = {"boundary": walk_boundary, "coordinate": walk_coordinate}
MODELS = ("bayes", "tpe", "cmaes")
