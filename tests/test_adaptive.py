"""The strategies that go by former trials, against plain versions on small fixtures."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import select
from cadenza.plans import adaptive, design, search
from cadenza.plans.rounds import SEQ, rated
from cadenza.sources import views

OFFSETS = {"a": 4.0, "b": 8.0, "hopeless": -80.0}


@pytest.fixture(scope="module")
def surface(spark):
    return search.shifted_surface(spark.createDataFrame(list(OFFSETS.items()), "segment_hash string, offset double"))


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([(s, "libsvtav1") for s in OFFSETS], "segment_hash string, encoder string")


@pytest.fixture(scope="module")
def history(spark, segments, surface):
    """Six measured trials of each segment."""
    points = design.sampled_design(views.spaces(spark), "random", 6, 5).where("encoder = 'libsvtav1'")
    return surface(segments.join(points, "encoder").withColumn("stage", F.lit(0)))


def _by_segment(at):
    out: dict[str, list] = {}
    for r in at.orderBy(*SEQ).collect():
        out.setdefault(r.segment_hash, []).append(r)
    return out


def _pool(spark, seed, seen):
    from_pool = adaptive.candidates(views.spaces(spark), seed).where("encoder = 'libsvtav1'").first().pool
    number = lambda x: str(int(x)) if x == int(x) else str(x)
    return [p for p in from_pool if f"crf={number(p.crf)},aq_mode={p.aq_mode},aq_strength={number(p.aq_strength)}" not in seen]


def test_tpe_proposes_what_a_plain_version_does(spark, history):
    at = adaptive.placed(history, views.spaces(spark), 85.0)
    got = {r.segment_hash: r.point for r in adaptive.propose_tpe(at, views.spaces(spark), 85.0, 3).collect()}
    rows = _by_segment(at)
    assert set(got) == set(OFFSETS)
    for segment, trials in rows.items():
        ranked = sorted(trials, key=lambda r: -r.fitness)
        cut = max(2, math.ceil(0.25 * len(ranked)))

        def log_density(point, side):
            total = 0.0
            for axis in adaptive.AXES:
                values = [r[axis] for r in side]
                spread = max(statistics.pstdev(values), 0.08)
                total -= 0.5 * ((point[axis] - statistics.fmean(values)) / spread) ** 2 + math.log(spread)
            return total

        ratio = lambda p: log_density(p, ranked[:cut]) - log_density(p, ranked[cut:])
        pool = _pool(spark, 3, {r.key for r in trials})
        assert ratio(got[segment]) == pytest.approx(max(map(ratio, pool)), abs=1e-9)


def test_gaussian_process_agrees_with_its_formula():
    rng = np.random.default_rng(1)
    x, at = rng.random((6, 3)), rng.random((9, 3))
    y = 90 - 30 * x[:, 0] + rng.normal(size=6)
    mean, spread = adaptive.posterior(x, y, at)
    z = (y - y.mean()) / y.std()
    best = None
    for length in adaptive.LENGTHS:
        for noise in adaptive.NOISES:
            k = adaptive.matern(x, x, length) + (noise + 1e-8) * np.eye(6)
            evidence = -0.5 * z @ np.linalg.inv(k) @ z - 0.5 * np.linalg.slogdet(k)[1]
            if best is None or evidence > best[0]:
                best = evidence, np.linalg.inv(k), adaptive.matern(x, at, length)
    _, inverse, across = best
    assert np.allclose(mean, y.mean() + y.std() * across.T @ inverse @ z)
    assert np.allclose(spread**2, y.var() * (1 - np.einsum("ij,ik,kj->j", across, inverse, across)), atol=1e-8)


def test_batches_of_processes_pick_what_each_alone_does():
    rng = np.random.default_rng(2)
    xs, ys, pools = [], [], []
    for i in range(300):
        n = 4 + i % 3
        xs.append(rng.random((n, 3)))
        ys.append(np.full(n, 90.0) if i % 50 == 7 else 95 - 30 * xs[-1][:, 0] + rng.normal(size=n))
        pools.append(rng.random((10 + i % 7, 3)))
    got = adaptive.batch_picks(xs, ys, pools, 85.0)
    for x, y, pool, place in zip(xs, ys, pools, got, strict=True):
        alone = adaptive.acquisition(x, y, pool, 85.0)
        assert place < len(pool) and alone[place] == pytest.approx(alone.max(), abs=1e-9)


def test_log_ratios_of_many_segments_are_those_of_the_formula():
    rng = np.random.default_rng(3)
    cube, sides = rng.random((7, 3)), rng.random((2, 5, 9)) + 0.1
    sides[:, :, 2::3] = 2 * np.log(sides[:, :, 1::3])
    got = adaptive.log_ratios(cube, *sides)
    density = lambda side, p: -0.5 * sum(((p[a] - side[3 * a]) / side[3 * a + 1]) ** 2 + 2 * math.log(side[3 * a + 1]) for a in range(3))
    assert np.allclose(got, [[density(g, p) - density(b, p) for p in cube] for g, b in zip(*sides, strict=True)])


def test_segments_that_share_points_pick_what_each_alone_does():
    rng = np.random.default_rng(4)
    sets, pool = [rng.random((4 + i % 3, 3)) for i in range(9)], rng.random((12, 3))
    xs = [sets[i % 9] for i in range(300)]
    ys = [np.full(len(x), 90.0) if i % 50 == 7 else 95 - 30 * x[:, 0] + rng.normal(size=len(x)) for i, x in enumerate(xs)]
    new = rng.random((300, 12)) < 0.8
    new[5] = False
    got = adaptive.pool_picks(xs, ys, pool, new, 85.0)
    assert got[5] == -1
    for i in (i for i in range(300) if i != 5):
        alone = adaptive.acquisition(xs[i], ys[i], pool[new[i]], 85.0)
        assert new[i][got[i]] and alone[new[i][: got[i]].sum()] == pytest.approx(alone.max(), abs=1e-9)


def test_pools_hold_each_point_once_whatever_the_sampler(spark):
    for sampler in ("halton", "sobol", "lhs"):
        for r in adaptive.candidates(views.spaces(spark), 1, 24, sampler).collect():
            keys = [p.key for p in r.pool]
            assert len(keys) == len(set(keys)) and [p.seq for p in r.pool] == sorted(p.seq for p in r.pool)


def test_bayes_proposes_the_highest_acquisition(spark, history):
    at = adaptive.placed(history, views.spaces(spark), 85.0)
    got = {r.segment_hash: r.point for r in adaptive.propose_bayes(at, views.spaces(spark), 85.0, 3).collect()}
    for segment, trials in _by_segment(at).items():
        pool = _pool(spark, 3, {r.key for r in trials})
        place = lambda rows: np.array([[r[a] for a in adaptive.AXES] for r in rows])
        values = adaptive.acquisition(place(trials), np.array([r.vmaf for r in trials]), place(pool), 85.0)
        assert got[segment] == pool[int(np.argmax(values))]


@pytest.mark.parametrize("model", adaptive.MODELS)
def test_models_make_new_trials_up_to_their_budget(spark, segments, surface, model):
    trials = adaptive.explore(segments, views.spaces(spark), surface, model, 85.0, n=8)
    again = adaptive.explore(segments, views.spaces(spark), surface, model, 85.0, n=8)
    rows = trials.collect()
    for segment in OFFSETS:
        own = [(r.crf, r.aq_mode, r.aq_strength) for r in rows if r.segment_hash == segment]
        assert len(own) == len(set(own)) and 6 <= len(own) <= 8
    assert sorted(rows) == sorted(again.collect())


def test_neighbours_are_one_step_away_on_the_grid(spark):
    spaces = views.spaces(spark)
    grid = [(r.mode_at, r.strength_at, r.aq_mode, r.aq_strength) for r in design.aq_grid(spaces).where("encoder = 'libsvtav1'").collect()]
    settings = [(f"s{i}", "libsvtav1", 85.0, m, s) for i, (m, s) in enumerate((g[2], g[3] + d) for g in grid for d in (0.0, 0.01))]
    got: dict[str, set] = {}
    for r in adaptive.neighbours(spark.createDataFrame(settings, "segment_hash string, encoder string, target double, aq_mode int, aq_strength double"), spaces).collect():
        got.setdefault(r.segment_hash, set()).add((r.aq_mode, r.aq_strength))
    for name, _, _, mode, strength in settings:
        i, j = min(grid, key=lambda g: (abs(g[2] - mode), abs(g[3] - strength), g[0], g[1]))[:2]
        assert got[name] == {(m, s) for a, b, m, s in grid if abs(a - i) + abs(b - j) == 1}


@pytest.mark.parametrize("walk", sorted(adaptive.WALKS))
def test_walks_solve_around_their_start_and_never_end_worse(spark, segments, surface, walk):
    spaces, targets = views.spaces(spark), views.targets(spark).where("target = 89")
    start = search.explore(segments, spaces, surface, "screen", 8)
    solve = lambda trials, settings: search.solve_settings(trials, settings, spaces, targets, surface)
    trials = adaptive.WALKS[walk](start, spaces, targets, surface, solve, rounds=2)
    best = lambda t: {r.segment_hash: r.proxy for r in select.best_aq(rated(t, targets), SEQ).collect()}
    before, after = best(start), best(trials)
    assert set(after) == set(OFFSETS) and all(after[s] >= before[s] for s in OFFSETS)
    near = {(r.segment_hash, r.aq_mode, r.aq_strength) for r in adaptive.neighbours(select.best_aq(rated(start, targets), SEQ), spaces).collect()}
    if walk == "boundary":
        assert near <= {(r.segment_hash, r.aq_mode, r.aq_strength) for r in trials.where("stage > 0").collect()}
    places = [(r.segment_hash, r.stage, r.seq) for r in trials.collect()]
    assert len(places) == len(set(places))


def test_segments_without_trials_give_nothing(spark, segments, surface):
    for model in adaptive.MODELS:
        assert adaptive.explore(segments.limit(0), views.spaces(spark), surface, model, 85.0, n=5).count() == 0


def test_a_solve_meets_the_recorded_trials_once(spark, sf_dir):
    recorded = views.trials(spark, sf_dir).where("l_partkey < 20")
    inner, spaces, targets = search.nearest_recorded(recorded), views.spaces(spark), views.targets(spark).where("target = 89")
    start = search.explore(recorded.select("segment_hash", "encoder").distinct(), spaces, inner, "screen", 8)
    settings = select.rank_aq(rated(start, targets), 2, SEQ).withColumnRenamed("rank", "place")
    carried = []

    def measure(proposals):
        carried.append("__points" in proposals.columns)
        return inner(proposals)

    measure.attached = inner.attached
    rows = lambda m: sorted(tuple(r) for r in search.solve_settings(start, settings, spaces, targets, m).collect())
    assert rows(measure) == rows(lambda p: inner(p)) and len(carried) > 2 and all(carried)
