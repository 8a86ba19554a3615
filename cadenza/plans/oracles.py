"""DuckDB SQL for the engine's queries."""

from __future__ import annotations

import re

SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
SEQ_DESC = ", ".join(f"{c} DESC" for c in SEQ.split(", "))

TRIALS = f"""trials AS (
  SELECT 'seg_' || l_partkey AS segment_hash, 'src_' || (l_partkey % 20) AS source, 'libsvtav1' AS encoder, (195 + 7 * CAST(l_quantity AS INT)) / 10.0::DOUBLE AS crf, CAST(l_linenumber % 2 AS INT) AS aq_mode,
    CAST(1 + l_suppkey % 4 AS DOUBLE) AS aq_strength, 'vmaf_v0.6.1neg' AS vmaf_model, 2 AS n_subsample, CAST(1000000 AS BIGINT) AS ref_bytes,
    CAST(950000 - 2300 * (7 * CAST(l_quantity AS INT) - 5) - 3000 * (l_linenumber % 2) * (1 + l_suppkey % 4) + 10000 * (l_partkey % 7) AS BIGINT) AS out_bytes,
    least(10000, greatest(0, 10600 - 5 * (7 * CAST(l_quantity AS INT) - 5) + 100 * (l_partkey % 13 - 6) + 20 * (l_linenumber % 2) * (1 + l_suppkey % 4))) / 100.0::DOUBLE AS vmaf, {SEQ} FROM lineitem
)"""
TARGETS = "targets AS (SELECT unnest([85.0::DOUBLE, 89.0::DOUBLE, 93.0::DOUBLE]) AS target)"
SCORED = f"""{TRIALS}, {TARGETS}, rated AS (
  SELECT *, CASE WHEN ref_bytes > 0 THEN CAST(out_bytes AS DOUBLE) / ref_bytes ELSE 1.0::DOUBLE END AS rate FROM trials CROSS JOIN targets
), parts AS (
  SELECT *, CASE WHEN rate > 0 THEN 1.0::DOUBLE / rate ELSE 0.0::DOUBLE END AS ratio, CASE WHEN rate >= 0.8::DOUBLE OR vmaf < target - 5 THEN 'none' WHEN vmaf < target THEN 'soft' ELSE 'met' END AS zone FROM rated
), components AS (
  SELECT *,
    CASE zone WHEN 'none' THEN 0.0::DOUBLE WHEN 'soft' THEN CASE WHEN ratio <= 20 THEN power((ratio - 1.0::DOUBLE) / 19.0::DOUBLE, 1.5::DOUBLE) ELSE 1.0::DOUBLE + 0.3::DOUBLE * ln(ratio / 20.0::DOUBLE) END
      ELSE CASE WHEN ratio <= 20 THEN power((ratio - 1.25::DOUBLE) / 18.75::DOUBLE, 0.9::DOUBLE) ELSE 1.0::DOUBLE + 0.1::DOUBLE * ln(ratio / 20.0::DOUBLE) END END AS compression,
    CASE zone WHEN 'none' THEN 0.0::DOUBLE WHEN 'soft' THEN 0.7::DOUBLE * power((vmaf - target + 5.0::DOUBLE) / 5.0::DOUBLE, 2.0::DOUBLE) ELSE 0.7::DOUBLE + 0.3::DOUBLE * least(1.0::DOUBLE, (vmaf - target) / (100.0::DOUBLE - target)) END AS quality
  FROM parts
), raw AS (
  SELECT *, least(1.0::DOUBLE, CASE zone WHEN 'none' THEN 0.0::DOUBLE WHEN 'soft' THEN compression * quality ELSE 0.7::DOUBLE * compression + 0.3::DOUBLE * quality END / 1.12::DOUBLE) AS score, vmaf >= target AND rate < 0.8::DOUBLE AS feasible FROM components
), scored AS (
  SELECT *, CASE WHEN score > 0 THEN score ELSE 1e-6::DOUBLE * least(vmaf, target) END AS proxy FROM raw
)"""
BEST = f"""{SCORED}, best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY segment_hash, target ORDER BY feasible DESC, CASE WHEN feasible THEN score ELSE vmaf END DESC, {SEQ}) = 1
)"""
TOP = f"""{SCORED}, top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY segment_hash, target ORDER BY score DESC, {SEQ}) AS INT) AS rank FROM scored WHERE feasible QUALIFY rank <= 5
)"""
PER_AQ = f"""{SCORED}, per_aq AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY segment_hash, target, aq_mode, aq_strength ORDER BY feasible DESC, CASE WHEN feasible THEN score ELSE proxy END DESC, {SEQ}) = 1
), best_aq AS (
  SELECT * FROM per_aq QUALIFY row_number() OVER (PARTITION BY segment_hash, target ORDER BY proxy DESC, aq_mode, aq_strength) = 1
)"""
RANKED = f"""{SCORED}, grouped AS (
  SELECT segment_hash, target, aq_mode, aq_strength, greatest(0.0::DOUBLE, max(proxy)) AS value, min(({SEQ})) AS first FROM scored GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY segment_hash, target ORDER BY value DESC, first) AS INT) AS rank FROM grouped
)"""
BRACKET = f"""{SCORED}, samples AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY segment_hash, aq_mode, aq_strength, target, crf ORDER BY {SEQ_DESC}) = 1
), lows AS (
  SELECT *, max(CASE WHEN vmaf >= target THEN crf END) OVER (PARTITION BY segment_hash, aq_mode, aq_strength, target) AS low FROM samples
), bracket AS (
  SELECT segment_hash, aq_mode, aq_strength, target, max(CASE WHEN vmaf >= target THEN crf END) AS crf_low, arg_max(vmaf, crf) FILTER (vmaf >= target) AS vmaf_low,
    min(CASE WHEN vmaf < target AND (low IS NULL OR crf > low) THEN crf END) AS crf_high, arg_min(vmaf, crf) FILTER (vmaf < target AND (low IS NULL OR crf > low)) AS vmaf_high
  FROM lows GROUP BY ALL
)"""
SPACES = """spaces AS (
  SELECT * FROM (VALUES ('libx265', 18.0::DOUBLE, 40.0::DOUBLE, [0, 1, 2, 3, 4], 0.0::DOUBLE, 2.0::DOUBLE, false), ('libx264', 18.0::DOUBLE, 40.0::DOUBLE, [0, 1, 2, 3], 0.0::DOUBLE, 2.0::DOUBLE, false),
    ('libsvtav1', 20.0::DOUBLE, 55.0::DOUBLE, [0, 1], 1.0::DOUBLE, 4.0::DOUBLE, true), ('hevc_nvenc', 18.0::DOUBLE, 40.0::DOUBLE, [0, 1], 1.0::DOUBLE, 15.0::DOUBLE, true),
    ('av1_nvenc', 18.0::DOUBLE, 45.0::DOUBLE, [0, 1], 1.0::DOUBLE, 15.0::DOUBLE, true), ('h264_nvenc', 18.0::DOUBLE, 38.0::DOUBLE, [0, 1], 1.0::DOUBLE, 15.0::DOUBLE, true))
  AS v(encoder, crf_min, crf_max, aq_modes, strength_min, strength_max, whole)
)"""
CLAMPED = f"""{TRIALS}, {SPACES}, moved AS (
  SELECT {SEQ}, crf * 1.5::DOUBLE - 10 AS crf, CAST(l_suppkey % 7 - 1 AS INT) AS aq_mode, aq_strength * 2.25::DOUBLE - 2 AS aq_strength FROM trials
), clamped AS (
  SELECT s.*, {SEQ}, round_even(least(greatest(crf, crf_min), crf_max), 1) AS crf, least(greatest(aq_mode, list_min(aq_modes)), list_max(aq_modes)) AS aq_mode,
    round_even(CASE WHEN whole THEN round_even(least(greatest(aq_strength, strength_min), strength_max), 0) ELSE least(greatest(aq_strength, strength_min), strength_max) END, 2) AS aq_strength FROM moved CROSS JOIN spaces s
)"""
GRID = f"""{SPACES}, strengths AS (
  SELECT *, CASE WHEN whole THEN list_transform(range(CAST(strength_min AS BIGINT), CAST(strength_max AS BIGINT) + 1), lambda i: CAST(i AS DOUBLE)) ELSE list_transform(range(0, 5), lambda i: strength_min + (strength_max - strength_min) * i / 4.0::DOUBLE) END AS strengths FROM spaces
), grid AS (
  SELECT encoder, mode_at, strength_at, aq_modes[mode_at] AS aq_mode, round_even(strengths[strength_at], 2) AS aq_strength, CAST(row_number() OVER (PARTITION BY encoder ORDER BY mode_at, strength_at) AS INT) AS seq
  FROM (SELECT *, unnest(range(1, len(strengths) + 1)) AS strength_at FROM (SELECT *, unnest(range(1, len(aq_modes) + 1)) AS mode_at FROM strengths))
)"""
CUTS = """cuts AS (
  SELECT user_id AS source, list_sort(list_distinct(list(t))) AS cuts, max(t) + 1.0::DOUBLE AS duration FROM (SELECT user_id, CAST((epoch_us(ts) - 1704067200000000) // 3600000000 AS DOUBLE) AS t FROM events) GROUP BY ALL
), plan AS (
  SELECT *, list_reduce(list_prepend([0.0::DOUBLE], list_transform(cuts, lambda t: [t])), lambda acc, t: CASE WHEN t[1] > 0 AND t[1] < duration AND t[1] - acc[len(acc)] >= 4 AND duration - t[1] >= 4 THEN list_concat(acc, t) ELSE acc END)[2:] AS kept FROM cuts
)"""
PIECES = f"""{CUTS}, edges AS (
  SELECT source, duration, list_concat([0.0::DOUBLE], kept, [duration]) AS e FROM plan
), spans AS (
  SELECT source, duration, e[i] AS a, e[i + 1] AS b FROM (SELECT *, unnest(range(1, len(e))) AS i FROM edges)
), inner_cuts AS (
  SELECT source, round(a + (b - a) / (q + 1) * unnest(range(1, q + 1)), 3) AS t FROM (SELECT *, CAST(floor((b - a) / 24.0::DOUBLE) AS BIGINT) AS q FROM spans WHERE b - a > 24)
  UNION SELECT source, round(b, 3) FROM spans WHERE b < duration
), ends AS (
  SELECT source, t FROM inner_cuts UNION SELECT source, 0.0::DOUBLE FROM plan UNION SELECT source, duration FROM plan
), pieces AS (
  SELECT source, CAST(row_number() OVER w - 1 AS INT) AS file, round(lead(t) OVER w - t, 3) AS length FROM ends WINDOW w AS (PARTITION BY source ORDER BY t) QUALIFY lead(t) OVER w IS NOT NULL
), starts AS (
  SELECT source, CAST(row_number() OVER w - 1 AS INT) AS idx, round(coalesce(sum(length) OVER (PARTITION BY source ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS start, length AS duration FROM pieces WHERE length > 0.05 WINDOW w AS (PARTITION BY source ORDER BY file)
)"""
FRAMES = """frames AS (
  SELECT label AS clip, vec_id AS frame, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, CAST(embedding AS DOUBLE[]) AS pixels FROM embeddings
)"""
FEATURE_LIST = ("spatial_information", "temporal_information", "motion_p95", "duration", "luma_mean", "luma_std", "color_complexity", "log_pixels")
FEATURES = f"""{TRIALS}, features AS (
  SELECT segment_hash, source, round(avg(vmaf), 6) AS spatial_information, round(stddev_pop(vmaf), 6) AS temporal_information, round(max(crf), 6) AS motion_p95, CAST(count(*) AS DOUBLE) AS duration, round(avg(out_bytes / 10000.0::DOUBLE), 6) AS luma_mean,
    round(min(vmaf), 6) AS luma_std, round(avg(aq_strength), 6) AS color_complexity, round(avg(CAST(l_suppkey AS DOUBLE)), 6) AS log_pixels FROM trials GROUP BY ALL
), long_form AS (UNPIVOT features ON {", ".join(FEATURE_LIST)} INTO NAME feature VALUE value)"""
#: What the other segments of a source say: their mean crf (in whole tenths, so that sums are exact), and their commoner mode.
_LEFT_OUT = """SELECT *, coalesce((sum(tenths) OVER w - tenths) / nullif(10.0::DOUBLE * (count(*) OVER w - 1), 0), crf) AS guess, CASE WHEN 2 * (sum(aq_mode) OVER w - aq_mode) > count(*) OVER w - 1 THEN 1 ELSE 0 END AS mode_guess
  FROM (SELECT *, CAST(round(crf * 10) AS BIGINT) AS tenths FROM best) WINDOW w AS (PARTITION BY source, target)"""
PREDICTED = f"""{BEST}, predicted AS (
  {_LEFT_OUT}
)"""
PROBE = """probed AS (
  SELECT page_id, CAST(640 + page_id % 5 * 320 AS INT) AS width, CAST(360 + page_id % 5 * 180 AS INT) AS height, [30000 / 1001.0::DOUBLE, 25.0::DOUBLE, 30.0::DOUBLE, 24000 / 1001.0::DOUBLE, 60.0::DOUBLE][page_id % 5 + 1] AS fps,
    CASE WHEN page_id % 4 <> 0 THEN page_id % 90 + 1.5::DOUBLE ELSE page_id % 90 + 2.25::DOUBLE END AS duration, CASE WHEN page_id % 3 = 0 THEN page_id % 400 + 10 END AS listed,
    ['yuv420p', 'yuv420p10le', 'yuv444p12le', 'gbrp', 'unknown', 'yuvj420p', 'rgb24'][page_id % 7 + 1] AS pix_fmt, CASE WHEN page_id % 2 = 0 THEN page_id % 1000 * 1000 + 5000 WHEN page_id % 5 <> 0 THEN 800000 END AS bits, CAST(length(html) AS BIGINT) AS size_bytes, page_id % 3 = 1 AS has_audio FROM pages
)"""

ORACLES = {
    "trial_score": f"WITH {SCORED} SELECT segment_hash, {SEQ}, target, round(score, 6) AS score, round(proxy, 9) AS proxy, round(compression, 6) AS compression, round(quality, 6) AS quality FROM scored",
    "score_reason": f"""WITH {SCORED} SELECT target, CASE zone WHEN 'none' THEN CASE WHEN rate >= 0.8::DOUBLE THEN printf('no meaningful compression (ratio %.2fx, rate %.3f); at least 1.25x required', round(ratio, 2), round(rate, 3)) ELSE printf('VMAF %.2f below hard cutoff %.2f', vmaf, target - 5) END
      WHEN 'soft' THEN printf('VMAF %.2f in soft zone (quality factor %.2f)', vmaf, round(quality, 2)) ELSE CASE WHEN ratio < 10 THEN 'success' ELSE 'success (excellent compression)' END END AS reason, count(*) AS n FROM scored GROUP BY ALL""",
    "feasible_trials": f"WITH {SCORED} SELECT segment_hash, target, {SEQ}, vmaf, round(rate, 9) AS rate FROM scored WHERE feasible",
    "top_trials": f"WITH {TOP} SELECT segment_hash, target, rank, crf, aq_mode, aq_strength, vmaf, round(score, 6) AS score FROM top",
    "best_or_closest": f"WITH {BEST} SELECT segment_hash, target, feasible, crf, aq_mode, aq_strength, vmaf, round(score, 6) AS score FROM best",
    "best_aq": f"WITH {PER_AQ} SELECT segment_hash, target, aq_mode, aq_strength, round(proxy, 9) AS value FROM best_aq",
    "rank_aq": f"WITH {RANKED} SELECT segment_hash, target, aq_mode, aq_strength, round(value, 9) AS value, rank FROM ranked",
    "refine_aq": f"WITH {RANKED} SELECT target, aq_mode, aq_strength, count(*) AS n_segments FROM ranked WHERE rank <= 2 GROUP BY ALL",
    "crf_bracket": f"WITH {BRACKET} SELECT * FROM bracket",
    "crf_guess": f"""WITH {BRACKET}, guessed AS (SELECT *, crf_high - crf_low AS span, CASE WHEN vmaf_low > vmaf_high THEN crf_low + (vmaf_low - target) * (crf_high - crf_low) / (vmaf_low - vmaf_high) ELSE 0.5::DOUBLE * (crf_low + crf_high) END AS s,
      crf_low + (1.0::DOUBLE - (sqrt(5.0::DOUBLE) - 1) / 2) * (crf_high - crf_low) AS g FROM bracket WHERE crf_low IS NOT NULL AND crf_high IS NOT NULL)
      SELECT segment_hash, aq_mode, aq_strength, target, round(least(greatest(s, crf_low + 0.2::DOUBLE * span), crf_high - 0.2::DOUBLE * span), 6) AS secant, round(least(greatest(g, crf_low + 0.2::DOUBLE * span), crf_high - 0.2::DOUBLE * span), 6) AS golden FROM guessed""",
    "iq_guess": f"""WITH {SCORED}, three AS (SELECT segment_hash, target, crf, vmaf, row_number() OVER (PARTITION BY segment_hash, target ORDER BY {SEQ_DESC}) AS n FROM scored QUALIFY n <= 3),
      p AS (SELECT segment_hash, target, count(*) AS k, max(CASE n WHEN 3 THEN crf END) AS x0, max(CASE n WHEN 2 THEN crf END) AS x1, max(CASE n WHEN 1 THEN crf END) AS x2, max(CASE n WHEN 3 THEN vmaf END) AS y0, max(CASE n WHEN 2 THEN vmaf END) AS y1, max(CASE n WHEN 1 THEN vmaf END) AS y2 FROM three GROUP BY ALL)
      SELECT segment_hash, target, CASE WHEN k = 3 AND y0 <> y1 AND y0 <> y2 AND y1 <> y2 THEN round((target - y1) * (target - y2) / ((y0 - y1) * (y0 - y2)) * x0 + (target - y0) * (target - y2) / ((y1 - y0) * (y1 - y2)) * x1 + (target - y0) * (target - y1) / ((y2 - y0) * (y2 - y1)) * x2, 4) END AS guess FROM p""",
    "explored_range": f"WITH {SCORED} SELECT segment_hash, target, min(vmaf) AS vmaf_min, max(vmaf) AS vmaf_max, count(*) AS n_trials FROM scored GROUP BY ALL",
    "tpe_split": f"""WITH {SCORED}, placed AS (SELECT segment_hash, target, (crf - 20.0::DOUBLE) / 35.0::DOUBLE AS u, row_number() OVER (PARTITION BY segment_hash, target ORDER BY proxy DESC, {SEQ}) AS place, count(*) OVER (PARTITION BY segment_hash, target) AS n FROM scored),
      cut AS (SELECT *, greatest(2, ceil(0.25::DOUBLE * n)) AS g FROM placed WHERE n >= 4)
      SELECT segment_hash, target, count(*) FILTER (place <= g) AS n_good, round(avg(u) FILTER (place <= g), 6) AS good_mean, round(greatest(stddev_pop(u) FILTER (place <= g), 0.08::DOUBLE), 6) AS good_std,
        round(avg(u) FILTER (CASE WHEN n > g THEN place > g ELSE place > n - 2 END), 6) AS bad_mean, round(greatest(stddev_pop(u) FILTER (CASE WHEN n > g THEN place > g ELSE place > n - 2 END), 0.08::DOUBLE), 6) AS bad_std FROM cut GROUP BY ALL""",
    "clamped_params": f"WITH {CLAMPED} SELECT encoder, {SEQ}, crf, aq_mode, aq_strength FROM clamped",
    "unit_cube": f"""WITH {CLAMPED}, placed AS (SELECT *, round((crf - crf_min) / (crf_max - crf_min), 9) AS crf_u, round((list_position(aq_modes, aq_mode) - 0.5::DOUBLE) / len(aq_modes), 9) AS mode_u, round((aq_strength - strength_min) / (strength_max - strength_min), 9) AS strength_u FROM clamped),
      back AS (SELECT *, strength_min + least(greatest(strength_u, 0), 0.999999::DOUBLE) * (strength_max - strength_min) AS s FROM placed)
      SELECT encoder, {SEQ}, crf_u, mode_u, strength_u, round_even(crf_min + least(greatest(crf_u, 0), 0.999999::DOUBLE) * (crf_max - crf_min), 1) AS crf, aq_modes[CAST(floor(least(greatest(mode_u, 0), 0.999999::DOUBLE) * len(aq_modes)) AS INT) + 1] AS aq_mode, round_even(CASE WHEN whole THEN round_even(s, 0) ELSE s END, 2) AS aq_strength FROM back""",
    "trial_keys": f"WITH {TRIALS} SELECT {SEQ}, segment_hash || '|' || encoder || '|crf=' || format('{{:g}}', round_even(crf, 1)) || ',aq_mode=' || aq_mode || ',aq_strength=' || format('{{:g}}', round_even(aq_strength, 2)) || '|' || vmaf_model || '|' || n_subsample AS key FROM trials",
    "aq_grid": f"WITH {TRIALS}, {GRID}, used AS (SELECT aq_mode, aq_strength, count(*) AS n FROM trials GROUP BY ALL) SELECT encoder, seq, g.aq_mode, g.aq_strength, coalesce(n, 0) AS n_trials FROM grid g LEFT JOIN used u ON g.aq_mode = u.aq_mode AND g.aq_strength = u.aq_strength",
    "aq_neighbors": f"""WITH {PER_AQ}, {GRID}, near AS (SELECT a.aq_mode, a.aq_strength, CAST(CASE WHEN b.mode_at < a.mode_at THEN 0 WHEN b.mode_at > a.mode_at THEN 1 WHEN b.strength_at < a.strength_at THEN 2 ELSE 3 END AS INT) AS way, b.aq_mode AS next_mode, b.aq_strength AS next_strength
      FROM grid a JOIN grid b ON a.encoder = b.encoder AND abs(a.mode_at - b.mode_at) + abs(a.strength_at - b.strength_at) = 1 WHERE a.encoder = 'libsvtav1')
      SELECT t.aq_mode, t.aq_strength, segment_hash, target, way, next_mode, next_strength FROM best_aq t JOIN near n ON t.aq_mode = n.aq_mode AND t.aq_strength = n.aq_strength""",
    "screen_plan": f"""WITH {TRIALS}, probes AS (SELECT unnest([round(20.0::DOUBLE + 35.0::DOUBLE / 3, 6), round(20.0::DOUBLE + 35.0::DOUBLE * 2 / 3, 6)]) AS crf)
      SELECT segment_hash, aq_mode, aq_strength, probes.crf AS crf, count(*) AS n_trials FROM trials CROSS JOIN probes GROUP BY ALL""",
    "grid_design": f"""WITH {TRIALS}, axis AS (SELECT unnest([0, 1, 2]) AS i), points AS (SELECT round_even(20.0::DOUBLE + 35.0::DOUBLE * c.i / 2, 1) AS crf, m.i AS aq_mode, round_even(round_even(1.0::DOUBLE + 3.0::DOUBLE * s.i / 2, 0), 2) AS aq_strength, c.i AS ci, m.i AS mi, s.i AS si FROM axis c, axis m, axis s WHERE m.i < 2),
      firsts AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY crf, aq_mode, aq_strength ORDER BY ci, mi, si) = 1), design AS (SELECT crf, aq_mode, aq_strength, CAST(row_number() OVER (ORDER BY ci, mi, si) AS INT) AS seq FROM firsts QUALIFY seq <= 16)
      SELECT s.segment_hash, d.crf, d.aq_mode, d.aq_strength, d.seq FROM (SELECT DISTINCT segment_hash FROM trials) s CROSS JOIN design d ANTI JOIN trials t ON t.segment_hash = s.segment_hash AND t.crf = d.crf AND t.aq_mode = d.aq_mode AND t.aq_strength = d.aq_strength""",
    "boundary_plan": f"WITH {CUTS} SELECT source, len(kept) AS n_kept, array_to_string(list_transform(kept, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS kept FROM plan",
    "boundary_pieces": f"WITH {PIECES} SELECT * FROM pieces",
    "segment_starts": f"WITH {PIECES} SELECT * FROM starts",
    "boundary_rows": f"WITH {PIECES} SELECT DISTINCT source, t AS boundary FROM inner_cuts",
    "segment_rows": f"WITH {PIECES} SELECT * FROM starts",
    "concat_lists": f"""WITH {PIECES} SELECT source, string_agg('file ''/work/src''\\''''' || source || '_' || lpad(CAST(idx AS VARCHAR), 4, '0') || '.mkv''', chr(10) ORDER BY idx) AS listing, round(sum(duration), 3) AS total FROM starts GROUP BY source""",
    "frame_motion": f"""WITH {FRAMES}, moved AS (SELECT clip, list_avg(pixels) AS level, list_avg(list_transform(list_zip(pixels, lag(pixels) OVER (PARTITION BY clip ORDER BY place)), lambda p: abs(p[1] - p[2]))) AS apart FROM frames)
      SELECT clip, count(*) AS n_frames, round(coalesce(avg(apart), 0), 9) AS motion_mean, round(coalesce(quantile_cont(apart, 0.95), 0), 9) AS motion_p95, round(avg(level), 9) AS luma_mean, round(stddev_pop(level), 9) AS luma_std FROM moved GROUP BY clip""",
    "frame_entropy": "WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL) SELECT doc_id, round(log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY doc_id",
    "frame_sample": f"""WITH {FRAMES}, sizes AS (SELECT clip, count(*) AS total FROM frames GROUP BY clip), ends AS (SELECT *, floor(total * 0.05::DOUBLE) AS lo, greatest(floor(total * 0.05::DOUBLE) + 1, floor(total * 0.95::DOUBLE)) AS hi FROM sizes),
      picks AS (SELECT DISTINCT clip, CASE WHEN total <= 12 THEN i ELSE CAST(round_even(lo + (hi - 1 - lo) * i / 11.0::DOUBLE, 0) AS BIGINT) END AS place FROM ends, range(0, 12) r(i) WHERE total > 12 OR i < total)
      SELECT f.clip, CAST(f.place AS INT) AS place, frame FROM frames f JOIN picks USING (clip, place)""",
    "frame_count_check": f"""WITH {TRIALS}, per AS (SELECT segment_hash, count(*) AS scored, count(DISTINCT crf) * 2 + 3 AS frames FROM trials GROUP BY ALL), e AS (SELECT *, (frames - 1) // 2 + 1 AS expected FROM per) SELECT *, scored <= expected + 1 AND scored >= expected - 2 AS trusted FROM e""",
    "pooled_quality": f"WITH {TRIALS} SELECT segment_hash, round(avg(vmaf), 9) AS mean, CASE WHEN min(vmaf) > 0 THEN round(count(*) / sum(1.0::DOUBLE / nullif(vmaf, 0)), 9) END AS harmonic, min(vmaf) AS least, count(*) AS n_scores FROM trials WHERE vmaf BETWEEN 0 AND 100 GROUP BY ALL",
    "pending_segments": f"WITH {TRIALS} SELECT DISTINCT segment_hash, source FROM trials WHERE l_partkey % 3 <> 0",
    "reused_sources": f"WITH {TRIALS} SELECT source, CASE WHEN bool_or(l_partkey % 3 = 0) THEN 'reused' ELSE 'new' END AS state FROM trials GROUP BY source",
}

_KEY = "segment_hash || '|' || encoder || '|crf=' || format('{:g}', round_even(crf, 1)) || ',aq_mode=' || aq_mode || ',aq_strength=' || format('{:g}', round_even(aq_strength, 2)) || '|' || vmaf_model || '|' || n_subsample"
_UPSERT = f"keyed AS (SELECT *, {_KEY} AS key FROM trials)"

ORACLES |= {
    "trial_upsert": f"WITH {TRIALS}, {_UPSERT} SELECT key, {SEQ}, vmaf, out_bytes FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY {SEQ_DESC}) = 1",
    "cache_lookup": f"""WITH {TRIALS}, {_UPSERT}, stored AS (SELECT key, vmaf FROM keyed WHERE l_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY {SEQ_DESC}) = 1)
      SELECT segment_hash, count(s.vmaf) AS hits, count(*) - count(s.vmaf) AS misses, max(s.vmaf) AS best_stored FROM keyed k LEFT JOIN stored s ON k.key = s.key GROUP BY ALL""",
    "corpus_progress": f"""WITH {SCORED}, per AS (SELECT source, segment_hash, target, bool_or(feasible) AS ok FROM scored GROUP BY ALL)
      SELECT source, count(DISTINCT segment_hash) AS n_segments, count(*) AS n_rows, count(*) FILTER (NOT ok) AS n_infeasible, round(100.0::DOUBLE * count(*) FILTER (NOT ok) / greatest(1, count(*)), 6) AS percent FROM per GROUP BY source""",
    "feature_ranges": f"WITH {FEATURES} SELECT feature, min(value) AS low, max(value) AS high FROM long_form GROUP BY feature",
    "domain_violations": f"""WITH {FEATURES}, bounds AS (SELECT feature, min(value) AS low, max(value) AS high FROM long_form WHERE source IN ('src_1', 'src_2', 'src_3') GROUP BY feature),
      slacks AS (SELECT *, CASE WHEN high > low THEN (high - low) * 0.15::DOUBLE ELSE greatest(abs(high), 1.0::DOUBLE) * 0.15::DOUBLE END AS slack FROM bounds)
      SELECT segment_hash, feature, value, low, high FROM long_form JOIN slacks USING (feature) WHERE value < low - slack OR value > high + slack""",
    "regression_metrics": f"""WITH {PREDICTED} SELECT target, count(*) AS n, round(avg(abs(guess - crf)), 6) AS mae, round(avg(guess - crf), 6) AS bias, round(1 - sum((guess - crf) * (guess - crf)) / nullif(count(*) * var_pop(crf), 0), 6) AS r2,
      round(avg(CASE WHEN guess <= crf + 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(quantile_cont(greatest(guess - crf, 0), 0.9), 6) AS overshoot_p90 FROM predicted GROUP BY target""",
    "mode_accuracy": f"WITH {PREDICTED} SELECT target, round(avg(CASE WHEN aq_mode = mode_guess THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM predicted GROUP BY target",
    "grouped_split": f"""WITH {FEATURES}, sources AS (SELECT DISTINCT source FROM features), placed AS (SELECT source, row_number() OVER (ORDER BY md5('0:' || source), source) AS place, count(*) OVER () AS n FROM sources),
      chosen AS (SELECT source FROM placed WHERE place <= CASE WHEN greatest(1, round_even(n * 0.25::DOUBLE, 0)) >= n THEN greatest(1, n - 1) ELSE greatest(1, round_even(n * 0.25::DOUBLE, 0)) END)
      SELECT segment_hash, source, source IN (SELECT source FROM chosen) AS validation FROM features""",
    "probe_rows": f"""WITH {PROBE} SELECT page_id, width, height, round(fps, 6) AS fps, duration, CASE WHEN listed > 0 THEN listed ELSE CAST(round_even(fps * duration, 0) AS BIGINT) END AS n_frames, 'h264' AS codec, pix_fmt,
      round(coalesce(bits, size_bytes * 8.0::DOUBLE / duration) / 1000.0::DOUBLE, 6) AS bitrate_kbps, size_bytes, has_audio FROM probed""",
    "pixfmt_resolve": f"""WITH {PROBE} SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'yuv422p' WHEN pix_fmt = 'unknown' THEN 'yuv420p' WHEN page_id % 4 = 2 THEN pix_fmt
      WHEN page_id % 4 = 0 THEN CASE WHEN pix_fmt IN ('yuv420p', 'yuv420p10le') THEN pix_fmt WHEN pix_fmt = 'yuv444p12le' THEN 'yuv420p10le' ELSE 'yuv420p' END
      WHEN page_id % 4 = 1 THEN 'gray' ELSE CASE WHEN pix_fmt IN ('yuv444p12le', 'gbrp') THEN 'yuv444p' ELSE 'yuv420p' END END AS chosen FROM probed""",
    "encode_arguments": f"""WITH {PROBE} SELECT page_id, 'keyint=' || CAST(greatest(1, round_even(fps * 2, 0)) AS INT) || ':preset=' || CASE WHEN page_id % 3 = 0 THEN page_id % 16 - 2 ELSE [0, 1, 2, 4, 6, 8, 9, 10, 12, 13][page_id % 10 + 1] END AS arguments,
      CASE WHEN page_id % 2 = 0 THEN 'mkv' ELSE 'mp4' END AS container, 'C\\\\:/it\\''s/\\[' || page_id || '\\]' AS escaped FROM probed""",
    "tool_listing": "SELECT DISTINCT conv_id AS doc, role || '_' || turn AS name FROM conversations c WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations f WHERE f.conv_id = c.conv_id AND f.turn = 0)",
    "progress_counts": "SELECT event_type AS event, count(*) AS n, min(epoch_us(ts) / 1000000.0::DOUBLE) AS first_ts, max(epoch_us(ts) / 1000000.0::DOUBLE) AS last_ts FROM events GROUP BY event_type",
}

ORACLES |= {
    "bundle_lookup": f"""WITH {TRIALS}, trained AS (SELECT 'lib' || (l_suppkey % 5) AS encoder, CASE WHEN l_linenumber % 4 > 0 THEN 80.0::DOUBLE + l_linenumber * 4 END AS target, min(vmaf) AS low FROM trials GROUP BY ALL),
      asked AS (SELECT DISTINCT 'lib' || (l_suppkey % 5) AS encoder, unnest([84.0::DOUBLE, 85.0::DOUBLE, 89.0::DOUBLE, 93.0::DOUBLE]) AS target FROM trials),
      own AS (SELECT encoder, target, 'models/' || encoder || '/target_' || format('{{:g}}', target) AS path FROM trained WHERE target IS NOT NULL),
      shared AS (SELECT encoder, low, 'models/' || encoder || '/all' AS path FROM trained WHERE target IS NULL AND encoder <> 'lib3')
      SELECT a.encoder, a.target, coalesce(o.path, s.path) AS path, o.path IS NOT NULL OR (s.path IS NOT NULL AND a.target >= s.low - 0.5::DOUBLE AND a.target <= 92.5::DOUBLE) AS fits
      FROM asked a LEFT JOIN own o ON a.encoder = o.encoder AND a.target = o.target LEFT JOIN shared s ON a.encoder = s.encoder""",
    "quality_logs": f"WITH {TRIALS} SELECT segment_hash, count(*) AS n_frames, round(avg(vmaf), 6) AS mean, round(count(*) / sum(1.0::DOUBLE / vmaf), 6) AS harmonic, min(vmaf) AS least, bool_and(vmaf BETWEEN 0 AND 100) AS plausible FROM trials GROUP BY ALL",
    "result_summary": f"""WITH {BEST} SELECT segment_hash, target, segment_hash || ' target ' || format('{{:g}}', target) || ': crf=' || format('{{:g}}', round_even(crf, 1)) || ',aq_mode=' || aq_mode || ',aq_strength=' || format('{{:g}}', aq_strength) || printf(' vmaf=%.2f out=%.4f MB [', vmaf, out_bytes / 1e6::DOUBLE) || CASE WHEN feasible THEN 'MET' ELSE 'MISSED' END || ']' AS line FROM best""",
}

RESULTS = f"""{BEST}, counted AS (
  SELECT segment_hash, target, count(*) AS n_trials FROM scored GROUP BY ALL
), top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY segment_hash, target ORDER BY score DESC, {SEQ}) AS INT) AS rank FROM scored WHERE feasible QUALIFY rank <= 5
), features AS (
  SELECT segment_hash, round(avg(vmaf), 6) AS spatial_information, round(stddev_pop(vmaf), 6) AS temporal_information, round(max(crf), 6) AS motion_p95, CAST(count(*) AS DOUBLE) AS duration, round(avg(out_bytes / 10000.0::DOUBLE), 6) AS luma_mean,
    round(min(vmaf), 6) AS luma_std, round(avg(aq_strength), 6) AS color_complexity, round(avg(CAST(l_suppkey AS DOUBLE)), 6) AS log_pixels FROM trials GROUP BY ALL
), dataset AS (
  SELECT source, 'segments/' || t.segment_hash || '.mkv' AS segment, t.segment_hash, t.target, true AS feasible, round_even(vmaf, 3) AS vmaf, round_even(rate, 6) AS rate, round_even(ratio, 3) AS ratio, round_even(score, 5) AS score, encoder, n_trials, {", ".join(f"f.{c}" for c in FEATURE_LIST)}, crf, aq_mode, aq_strength, rank
  FROM top t JOIN counted c ON t.segment_hash = c.segment_hash AND t.target = c.target JOIN features f ON f.segment_hash = t.segment_hash
)"""
_CELLS = (*FEATURE_LIST, "crf", "aq_mode", "aq_strength")
MANIFEST = f"""{TRIALS}, per AS (
  SELECT DISTINCT source, l_partkey AS k FROM trials
), items AS (
  SELECT source, 'cut/' || k AS path, CAST(k AS INT) AS index, k * 0.5::DOUBLE AS start, 6.25::DOUBLE AS duration FROM per WHERE k % 11 <> 0 AND k % 7 > 0 AND source <> 'src_9'
), files AS (
  SELECT 'cut/' || k AS path FROM per WHERE k % 5 > 0 OR source IN ('src_1', 'src_2')
)"""
PICTURES = f"""{FRAMES}, levels AS (
  SELECT clip, place, frame, CASE WHEN frame % 13 > 0 THEN list_transform(pixels, lambda p: floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, 128.0::DOUBLE + p * 200.0::DOUBLE)))) END AS pixels FROM frames
)"""


def _at(y: str, x: str) -> str:
    mirrored = lambda v: f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > 7 THEN 14 - ({v}) ELSE {v} END)"
    return f"pixels[{mirrored(y)} * 8 + {mirrored(x)} + 1]"


def _gradient(weights: list[tuple[int, int, int]]) -> str:
    return " + ".join(f"{w} * {_at(f'(i // 8 + {dy})', f'(i % 8 + {dx})')}" for dy, dx, w in weights)


_GX = _gradient([(-1, 1, 1), (0, 1, 2), (1, 1, 1), (-1, -1, -1), (0, -1, -2), (1, -1, -1)])
_GY = _gradient([(1, -1, 1), (1, 0, 2), (1, 1, 1), (-1, -1, -1), (-1, 0, -2), (-1, 1, -1)])

#: A number in tenths, half-even by its decimal digits: a tie is one only if the shortest decimal that means the number is one.
_TENTHS = "CAST(list_transform([CAST(CAST({0} AS VARCHAR) AS DECIMAL(25, 17)) * 10], lambda d: CASE WHEN d - floor(d) > 0.5 OR (d - floor(d) = 0.5 AND CAST(floor(d) AS BIGINT) % 2 = 1) THEN CAST(floor(d) AS BIGINT) + 1 ELSE CAST(floor(d) AS BIGINT) END)[1] AS DOUBLE) / 10.0::DOUBLE"
#: The recorded trials of each segment's setting, the last at each crf; NEAREST: the one of the nearest crf, of two as near the lower.
POINTS = f"""points AS MATERIALIZED (
  SELECT segment_hash, aq_mode, aq_strength, list({{'c': crf, 'v': vmaf, 'o': out_bytes}}) AS p
  FROM (SELECT * FROM trials QUALIFY row_number() OVER (PARTITION BY segment_hash, crf, aq_mode, aq_strength ORDER BY {SEQ_DESC}) = 1) GROUP BY ALL
)"""
NEAREST = "list_min(list_transform(p, lambda x: {{'apart': abs(x.c - {0}), 'c': x.c, 'v': x.v, 'o': x.o}}))"
#: Brackets (FROM, with KEYS) narrowed while they are wide and probes lie between their ends: a row for each probe, i from 1.
SOLVE = """solve AS (
  SELECT KEYS, crf_low, vmaf_low, crf_high, vmaf_high, [crf_low, crf_high] AS hx, [vmaf_low, vmaf_high] AS hy, 0 AS i, CAST(NULL AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS BIGINT) AS o, false AS stuck FROM BRACKETS
  UNION ALL
  SELECT KEYS, CASE WHEN ok AND m.v >= target THEN c ELSE crf_low END, CASE WHEN ok AND m.v >= target THEN m.v ELSE vmaf_low END, CASE WHEN ok AND m.v < target THEN c ELSE crf_high END, CASE WHEN ok AND m.v < target THEN m.v ELSE vmaf_high END,
    list_append(hx, c), list_append(hy, m.v), i + 1, c, m.v, m.o, NOT ok
  FROM (
    SELECT g.* EXCLUDE (c, v, o), g.nextc AS c, MEASURE AS m, coalesce(g.nextc > crf_low AND g.nextc < crf_high, false) AS ok FROM (
      SELECT *, TENTHS AS nextc FROM (
        SELECT *, coalesce(GUESS, CASE WHEN vmaf_low > vmaf_high THEN crf_low + (vmaf_low - target) * (crf_high - crf_low) / (vmaf_low - vmaf_high) ELSE 0.5::DOUBLE * (crf_low + crf_high) END) AS guess
        FROM solve WHERE i < 6 AND NOT stuck AND crf_high - crf_low > 0.5::DOUBLE
      )
    ) g JOIN points r ON g.segment_hash = r.segment_hash AND g.aq_mode = r.aq_mode AND g.aq_strength = r.aq_strength
  )
)"""
SOLVE = SOLVE.replace("TENTHS", _TENTHS.format("least(greatest(guess, crf_low + 0.2::DOUBLE * (crf_high - crf_low)), crf_high - 0.2::DOUBLE * (crf_high - crf_low))")).replace("MEASURE", NEAREST.format("g.nextc"))
_BRACKETS = SOLVE.replace("KEYS", "segment_hash, aq_mode, aq_strength, target").replace("BRACKETS", "bracket")
_X = [f"hx[{k}]" for k in (-3, -2, -1)]
_Y = [f"hy[{k}]" for k in (-3, -2, -1)]
IQ = f"""CASE WHEN len(hx) >= 3 AND {_Y[0]} <> {_Y[1]} AND {_Y[1]} <> {_Y[2]} AND {_Y[0]} <> {_Y[2]} THEN (target - {_Y[1]}) * (target - {_Y[2]}) / (({_Y[0]} - {_Y[1]}) * ({_Y[0]} - {_Y[2]})) * {_X[0]}
  + (target - {_Y[0]}) * (target - {_Y[2]}) / (({_Y[1]} - {_Y[0]}) * ({_Y[1]} - {_Y[2]})) * {_X[1]} + (target - {_Y[0]}) * (target - {_Y[1]}) / (({_Y[2]} - {_Y[0]}) * ({_Y[2]} - {_Y[1]})) * {_X[2]} END"""
_SOLVED = "SELECT segment_hash, aq_mode, aq_strength, target, crf_low, vmaf_low, crf_high, vmaf_high FROM solve QUALIFY row_number() OVER (PARTITION BY segment_hash, aq_mode, aq_strength, target ORDER BY i DESC) = 1"

#: The points 1 to n of the sampled designs, from the definitions of the sequences.
_DRAW = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _halton(base: int) -> str:
    """Digits of the number, each replaced by its place in the order of MD5s that belongs to its position, mirrored at the point."""
    n = {2: 30, 3: 19, 5: 13}[base]
    hashed = lambda d: f"md5('0:halton{base}:' || j || ':' || {d}) || {d}"
    digit = f"CAST((nr // CAST(pow({base}, j) AS BIGINT)) % {base} AS BIGINT)"
    rank = " + ".join(f"CASE WHEN {hashed(d)} < {hashed(digit)} THEN 1 ELSE 0 END" for d in range(base))
    return f"(CAST(list_sum(list_transform(range(0, {n}), lambda j: ({rank}) * CAST(pow({base}, {n - 1} - j) AS BIGINT))) AS DOUBLE) + 0.5::DOUBLE) / {base**n}.0::DOUBLE"


def _sobol(axis: int) -> str:
    """Bits of the index pick direction numbers: those of the van der Corput sequence, and of the polynomials x + 1 and x^2 + x + 1; then
    a digit is turned where the MD5 of the digits before it is odd in its first place."""
    m = [[1] * 5, [1, 3, 5, 15, 17], [1, 3, 3, 9, 29]][axis]  # initial numbers m_k of the axes (fixed values)
    bits = " ".join(f"WHEN {j} THEN {v << (29 - j)}" for j, v in enumerate(m))
    picked = f"list_transform(range(0, 5), lambda j: CASE WHEN ((nr - 1) >> j) & 1 = 1 THEN CASE j {bits} END ELSE 0 END)"
    plain = f"list_reduce(list_prepend(CAST(0 AS BIGINT), {picked}), lambda a, b: xor(a, CAST(b AS BIGINT)))"
    turn = f"CAST('0x' || substr(md5('0:sobol{axis}:' || k || ':' || (x >> CAST(30 - k AS INT))), 1, 1) AS BIGINT) & 1"
    return f"list_transform([{plain}], lambda x: (CAST(list_sum(list_transform(range(0, 30), lambda k: xor((x >> CAST(29 - k AS INT)) & 1, {turn}) * CAST(pow(2, 29 - k) AS BIGINT))) AS DOUBLE) + 0.5::DOUBLE) / 1073741824.0::DOUBLE)[1]"


def sampled(method: str, n: int = 16) -> str:
    """CTEs up to points (encoder, crf, aq_mode, aq_strength, seq)."""
    each = lambda a: _DRAW.format(f"'0:' || encoder || ':' || nr || ':{a}'")
    if method == "sobol":
        u = [_sobol(a) for a in range(3)]
    elif method == "halton":
        u = [_halton(b) for b in (2, 3, 5)]
    elif method == "lhs":
        u = [f"(row_number() OVER (PARTITION BY encoder ORDER BY {_DRAW.format(f"'0:' || encoder || ':' || nr || ':order{a}'")}, nr) - 1 + {each(a)}) / {n}.0::DOUBLE" for a in range(3)]
    else:
        u = [each(a) for a in range(3)]
    inside = lambda v: f"least(greatest({v}, 0.0::DOUBLE), 0.999999::DOUBLE)"
    return f"""{SPACES}, drawn AS (
  SELECT *, {u[0]} AS u0, {u[1]} AS u1, {u[2]} AS u2 FROM (SELECT *, unnest(range(1, {n} + 1)) AS nr FROM spaces)
), moved AS (
  SELECT encoder, nr, round_even(crf_min + {inside("u0")} * (crf_max - crf_min), 1) AS crf, aq_modes[CAST(least(len(aq_modes), floor({inside("u1")} * len(aq_modes)) + 1) AS INT)] AS aq_mode, strength_min + {inside("u2")} * (strength_max - strength_min) AS s, whole FROM drawn
), rounded AS (
  SELECT encoder, nr, crf, aq_mode, round_even(CASE WHEN whole THEN round_even(s, 0) ELSE s END, 2) AS aq_strength FROM moved
), points AS (
  SELECT encoder, crf, aq_mode, aq_strength, row_number() OVER (PARTITION BY encoder ORDER BY nr) AS seq FROM (SELECT * FROM rounded QUALIFY row_number() OVER (PARTITION BY encoder, crf, aq_mode, aq_strength ORDER BY nr) = 1) QUALIFY seq <= {n}
)"""


def _sampler(method: str) -> str:
    design = sampled(method).replace("points AS (", "design AS (")
    return f"""WITH {TRIALS}, {POINTS}, {design}, met AS (
  SELECT s.segment_hash, d.*, {NEAREST.format("d.crf")} AS m FROM (SELECT DISTINCT segment_hash, encoder FROM trials) s JOIN design d ON s.encoder = d.encoder
  LEFT JOIN points r ON r.segment_hash = s.segment_hash AND r.aq_mode = d.aq_mode AND r.aq_strength = d.aq_strength
) SELECT * EXCLUDE (m), m.v AS vmaf, m.o AS out_bytes, CASE WHEN m IS NOT NULL THEN CAST(1000000 AS BIGINT) END AS ref_bytes FROM met"""


_PARAMS = "'crf=' || format('{{:g}}', {0}) || ',aq_mode=' || {1} || ',aq_strength=' || format('{{:g}}', {2})"
_CLAMP_STRENGTH = "round_even(CASE WHEN whole THEN round_even({0}, 0) ELSE {0} END, 2)"
_ARGV = f"""{PROBE}, {SPACES}, asked AS (
  SELECT p.*, s.*, CASE WHEN page_id % 12 < 6 THEN 'slow' ELSE 'fast' END AS preset, 'keyint' AS k, CAST(greatest(1, round_even(fps * 2, 0)) AS INT) AS key, round_even(least(greatest(15.0::DOUBLE + page_id % 50, crf_min), crf_max), 1) AS crf, least(page_id % 3, list_max(aq_modes)) AS aq,
    {_CLAMP_STRENGTH.format("least(greatest((page_id % 9) * 0.25::DOUBLE, strength_min), strength_max)")} AS strength, CASE WHEN page_id % 5 > 0 THEN ' -threads ' || page_id % 5 ELSE '' END AS threads
  FROM probed p JOIN spaces s ON s.encoder = ['libx265', 'libx264', 'libsvtav1', 'hevc_nvenc', 'av1_nvenc', 'h264_nvenc'][page_id % 6 + 1]
)"""

ORACLES |= {
    "dataset_rows": f"WITH {RESULTS} SELECT * EXCLUDE (rank) FROM dataset",
    "training_rows": f"WITH {RESULTS} SELECT source, segment_hash, target, rank, vmaf, rate, ratio, score, encoder, n_trials, crf, aq_mode, aq_strength FROM dataset",
    "infeasible_share": f"WITH {RESULTS}, n AS (SELECT count(*) AS n_rows FROM dataset) SELECT encoder, count(*) AS n_results, count(*) FILTER (NOT feasible) AS n_infeasible, any_value(n_rows) AS n_rows, round(100.0::DOUBLE * count(*) FILTER (NOT feasible) / greatest(1, any_value(n_rows)), 6) AS percent FROM best, n GROUP BY encoder",
    "latest_records": f"""WITH {TRIALS}, segments AS (SELECT DISTINCT segment_hash, source, l_partkey AS k FROM trials)
      SELECT 2 * k + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS pos, segment_hash, CASE WHEN k % 2 = 0 THEN replace(source, 'src_', 'again_') ELSE source END AS source, CAST(3 AS BIGINT) AS n_targets, CAST(8 AS BIGINT) AS n_features FROM segments WHERE k % 2 = 0 OR k % 5 <> 0""",
    "design_matrix": f"""WITH {RESULTS} SELECT source, count(*) AS n, {", ".join(f"round(sum({c}), 2) AS {c}" for c in _CELLS)}, 0.0::DOUBLE AS vmaf_target, 'target_89' AS model FROM dataset WHERE target = 89 GROUP BY source
      UNION ALL BY NAME SELECT source, count(*) AS n, {", ".join(f"round(sum({c}), 2) AS {c}" for c in _CELLS)}, round(sum(target), 4) AS vmaf_target, 'all' AS model FROM dataset GROUP BY source""",
    "training_groups": f"WITH {RESULTS} SELECT target, count(*) AS n_rows, count(DISTINCT segment_hash) AS n_segments, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM dataset GROUP BY target",
    "completeness": f"WITH {TRIALS}, s AS (SELECT DISTINCT source, segment_hash, l_partkey AS k FROM trials) SELECT source, count(*) AS expected, count(*) FILTER (k % 3 > 0 OR k % 20 < 5) AS searched, bool_and(k % 3 > 0 OR k % 20 < 5) AS complete FROM s GROUP BY source",
    "metadata_ranges": f"WITH {RESULTS} SELECT target, n_train, CAST(8 AS INT) AS n_features, feature, low, high FROM ({' UNION ALL '.join(f"SELECT target, count(*) AS n_train, '{c}' AS feature, min({c}) AS low, max({c}) AS high FROM dataset GROUP BY target" for c in FEATURE_LIST)})",
    "package_manifest": f"""WITH {BEST}, rates AS (SELECT encoder, target, round(avg(CASE WHEN feasible THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit, encoder || '/target_' || format('{{:g}}', target) AS path FROM best GROUP BY ALL)
      SELECT encoder, '{{"package":"compress","models":[' || string_agg('{{"path":"' || path || '","encoder":"' || encoder || '","target":' || CAST(target AS VARCHAR) || ',"hit_rate":' || CAST(hit AS VARCHAR) || '}}', ',' ORDER BY path) || ']}}' AS manifest FROM rates GROUP BY encoder""",
    "run_summary": f"""WITH {RESULTS}, n AS (SELECT count(*) AS n_rows FROM dataset)
      SELECT encoder, '{{"sources":' || count(DISTINCT source) || ',"segments":' || count(DISTINCT segment_hash) || ',"rows":' || any_value(n_rows) || ',"infeasible":' || count(*) FILTER (NOT feasible) || ',"encoder":"' || encoder || '","targets":[85.0,89.0,93.0]}}' AS summary FROM best, n GROUP BY encoder""",
    "segment_manifest": f"""WITH {MANIFEST}, reused AS (SELECT source, path, index, start FROM items SEMI JOIN files USING (path) WHERE source <> 'src_3')
      SELECT * FROM reused UNION ALL SELECT DISTINCT source, CAST(NULL AS VARCHAR), CAST(NULL AS INT), CAST(NULL AS DOUBLE) FROM trials WHERE source <> 'src_3' AND source NOT IN (SELECT source FROM reused)""",
    "complete_manifests": f"WITH {MANIFEST} SELECT source, path, index, duration FROM items WHERE source NOT IN (SELECT source FROM items WHERE path NOT IN (SELECT path FROM files))",
    "frame_counts": "SELECT page_id AS doc, CASE WHEN page_id % 5 > 0 THEN page_id + 7 END AS n_frames FROM pages",
    "listed_formats": f"""WITH {PROBE}, l AS (SELECT page_id AS doc, pix_fmt, ['yuv420p yuv420p10le', 'gray nv12', '', ''][page_id % 4 + 1] AS formats FROM probed)
      SELECT doc, formats, CASE WHEN pix_fmt = 'unknown' THEN 'yuv420p' WHEN formats = '' THEN pix_fmt WHEN formats = 'gray nv12' THEN 'gray' WHEN pix_fmt IN ('yuv420p', 'yuv420p10le') THEN pix_fmt WHEN pix_fmt = 'yuv444p12le' THEN 'yuv420p10le' ELSE 'yuv420p' END AS chosen FROM l""",
    "encode_argv": f"""WITH {_ARGV}, named AS (SELECT *, CASE WHEN preset = 'slow' THEN 4 ELSE 8 END AS number, format('{{:g}}', crf) AS c, format('{{:g}}', strength) AS s FROM asked)
      SELECT page_id, encoder, 'ffmpeg -hide_banner -nostdin -y -loglevel error -i in/' || page_id || ' -map 0:v:0 -an -sn -dn' || CASE WHEN encoder = 'libsvtav1' THEN ' -fps_mode passthrough' ELSE '' END || ' -c:v ' || encoder || ' -pix_fmt ' || pix_fmt || ' -preset ' || CASE WHEN encoder = 'libsvtav1' THEN CAST(number AS VARCHAR) ELSE preset END ||
        CASE WHEN encoder IN ('libx264', 'libx265') THEN ' -crf ' || c || ' -' || substr(encoder, 4) || '-params aq-mode=' || aq || ':aq-strength=' || s || ':keyint=' || key || ':min-keyint=' || key || ':scenecut=0' || CASE WHEN encoder = 'libx265' THEN ':log-level=error' ELSE '' END
        WHEN encoder = 'libsvtav1' THEN ' -crf ' || c || ' -svtav1-params enable-variance-boost=' || aq || ':variance-boost-strength=' || CAST(strength AS INT) || ':keyint=' || key || ':scd=0'
        ELSE ' -rc vbr -cq ' || c || ' -b:v 0 -spatial-aq ' || CASE WHEN aq > 0 THEN '1 -aq-strength ' || CAST(strength AS INT) ELSE '0' END || ' -g ' || key || ' -keyint_min ' || key || ' -sc_threshold 0' END || threads || CASE WHEN page_id % 4 = 0 THEN ' -tag:v t' || page_id ELSE '' END || ' out.mkv' AS argv FROM named""",
    "space_guesses": f"""WITH {TRIALS}, {SPACES}, crfs AS (SELECT floor(crf / 5) * 5.0::DOUBLE AS failed, count(*) AS n_trials FROM trials GROUP BY ALL)
      SELECT encoder, failed, n_trials, '{{"aq_modes":' || replace(CAST(aq_modes AS VARCHAR), ' ', '') || ',"aq_strength_is_integer":' || whole || ',"aq_strength_max":' || strength_max || ',"aq_strength_min":' || strength_min || ',"crf_max":' || crf_max || ',"crf_min":' || crf_min || '}}' AS space,
        {_PARAMS.format("round_even((crf_min + crf_max) / 2, 1)", "aq_modes[len(aq_modes) // 2 + 1]", _CLAMP_STRENGTH.format("((strength_min + strength_max) / 2)"))} AS middle, {_PARAMS.format("round_even(least(greatest(failed - 4, crf_min), crf_max), 1)", "aq_modes[1]", "strength_min")} AS again,
        CASE CAST(floor(failed / 10) AS INT) WHEN 1 THEN 85.0::DOUBLE WHEN 2 THEN 89.0::DOUBLE WHEN 3 THEN 93.0::DOUBLE END AS level_target FROM crfs CROSS JOIN spaces""",
    "video_plan": f"""WITH {PIECES}, guessed AS (SELECT *, 24.0::DOUBLE + idx % 3 * 3 AS fps, round_even(least(greatest(10.0::DOUBLE + fmod(idx * 1.37::DOUBLE, 60), 20), 55), 1) AS crf, least(idx % 4, 1) AS aq_mode, round_even(least(greatest(idx % 7 * 0.8::DOUBLE, 1), 4), 0) AS aq_strength FROM starts)
      SELECT source, idx, start, duration, fps, crf, aq_mode, aq_strength, round_even(least(greatest(crf - 4, 20), 55), 1) AS retry_crf FROM guessed""",
    "fallback_pieces": f"""WITH {PIECES.replace("FROM cuts\n), edges", "FROM (SELECT source, duration, CASE WHEN source % 3 = 0 THEN list_transform(range(1, CAST(ceil(duration / 6.0::DOUBLE) AS BIGINT)), lambda i: i * 6.0::DOUBLE) ELSE cuts END AS cuts FROM cuts)\n), edges")} SELECT * FROM pieces""",
    "record_lines": f"""WITH {RESULTS}, guessed AS ({_LEFT_OUT})
      SELECT segment_hash, string_agg('t' || format('{{:g}}', target) || CASE WHEN feasible THEN ' ok' ELSE ' infeasible' END || printf(' vmaf=%.2f', vmaf) || ' crf=' || format('{{:g}}', crf) || ' aq=' || aq_mode || '/' || format('{{:g}}', aq_strength) || ' trials=' || n_trials, '; ' ORDER BY target) AS line FROM best JOIN counted USING (segment_hash, target) GROUP BY segment_hash
      UNION ALL SELECT 'report ' || format('{{:g}}', target), 'target ' || format('{{:g}}', target) || ' train=' || count(*) || printf(' crf MAE=%.2f', round(avg(abs(guess - crf)), 2)) || ' hit-rate=' || CAST(round_even(avg(CASE WHEN guess <= crf + 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) * 100, 0) AS INT) || '%' FROM guessed GROUP BY target""",
    "scene_features": f"""WITH {PICTURES}, read AS (SELECT *, lag(pixels) OVER (PARTITION BY clip ORDER BY place) AS before FROM levels WHERE pixels IS NOT NULL),
      steps AS (SELECT *, list_transform(range(0, 64), lambda i: sqrt(power({_GX}, 2) + power({_GY}, 2))) AS edges, list_transform(list_zip(pixels, before), lambda p: abs(p[1] - p[2])) AS apart FROM read),
      bytes AS (SELECT clip, place, c, v, count(*) AS n FROM (SELECT clip, place, c, unnest(list_transform(pixels, lambda p: CAST(floor(p / c) AS INT))) AS v FROM read, (SELECT unnest([1, 4, 16]) AS c)) GROUP BY ALL),
      colour AS (SELECT clip, place, avg(e) AS e FROM (SELECT clip, place, c, 6 - sum(n * log2(n)) / 64 AS e FROM bytes GROUP BY ALL) GROUP BY ALL),
      shown AS (SELECT clip, count(*) / 24.0::DOUBLE AS duration, log10(CAST(640 * 360 * (1 + clip % 4) AS DOUBLE)) AS log_pixels FROM levels GROUP BY clip)
      SELECT s.clip, count(*) AS n_frames, round(avg(list_stddev_pop(edges)), 6) AS spatial_information, round(coalesce(avg(CASE WHEN before IS NOT NULL THEN list_stddev_pop(apart) END), 0), 6) AS temporal_information, round(coalesce(quantile_cont(CASE WHEN before IS NOT NULL THEN list_avg(apart) / 255 END, 0.95), 0), 6) AS motion_p95,
        round(any_value(duration), 6) AS duration, round(avg(list_avg(pixels)), 6) AS luma_mean, round(avg(list_stddev_pop(pixels)), 6) AS luma_std, round(avg(e), 6) AS color_complexity, round(any_value(log_pixels), 6) AS log_pixels FROM steps s JOIN colour USING (clip, place) JOIN shown USING (clip) GROUP BY s.clip""",
    "picture_features": f"""WITH {PICTURES}, grey AS (SELECT clip, place, list_transform(pixels, lambda p: CAST((CAST(floor(p) AS BIGINT) * 1868 + CAST(floor(p / 4) AS BIGINT) * 9617 + CAST(floor(p / 16) AS BIGINT) * 4899 + 8192) // 16384 AS DOUBLE)) AS pixels, pixels AS levels FROM levels WHERE pixels IS NOT NULL),
      read AS (SELECT *, lag(pixels) OVER (PARTITION BY clip ORDER BY place) AS before FROM grey),
      steps AS (SELECT *, list_transform(range(0, 64), lambda i: sqrt(power({_GX}, 2) + power({_GY}, 2))) AS edges, list_transform(list_zip(pixels, before), lambda p: abs(p[1] - p[2])) AS apart FROM read),
      bytes AS (SELECT clip, place, c, v, count(*) AS n FROM (SELECT clip, place, c, unnest(list_transform(levels, lambda p: CAST(floor(p / c) AS INT))) AS v FROM grey, (SELECT unnest([1, 4, 16]) AS c)) GROUP BY ALL),
      colour AS (SELECT clip, place, avg(e) AS e FROM (SELECT clip, place, c, 6 - sum(n * log2(n)) / 64 AS e FROM bytes GROUP BY ALL) GROUP BY ALL),
      shown AS (SELECT clip, count(*) / 24.0::DOUBLE AS duration, log10(CAST(640 * 360 * (1 + clip % 4) AS DOUBLE)) AS log_pixels FROM levels GROUP BY clip)
      SELECT s.clip, count(*) AS n_frames, round(avg(list_stddev_pop(edges)), 5) AS spatial_information, round(coalesce(avg(CASE WHEN before IS NOT NULL THEN list_stddev_pop(apart) END), 0), 5) AS temporal_information, round(coalesce(quantile_cont(CASE WHEN before IS NOT NULL THEN list_avg(apart) / 255 END, 0.95), 0), 5) AS motion_p95,
        round(any_value(duration), 5) AS duration, round(avg(list_avg(pixels)), 5) AS luma_mean, round(avg(list_stddev_pop(pixels)), 5) AS luma_std, round(avg(e), 5) AS color_complexity, round(any_value(log_pixels), 5) AS log_pixels FROM steps s JOIN colour USING (clip, place) JOIN shown USING (clip) GROUP BY s.clip""",
    "frame_pairs": f"""WITH {FRAMES}, a AS (SELECT clip, frame, pixels[1] AS v, row_number() OVER (PARTITION BY clip ORDER BY frame) AS n FROM frames), b AS (SELECT clip, frame, pixels[1] AS v, row_number() OVER (PARTITION BY clip ORDER BY frame) AS n FROM frames WHERE frame % 7 > 0)
      SELECT a.clip, count(*) AS n_pairs, count(*) FILTER (a.frame = b.frame) AS n_same, round(avg(abs(a.v - b.v)), 9) AS apart FROM a JOIN b ON a.clip = b.clip AND a.n = b.n GROUP BY a.clip""",
    "crf_solve": f"WITH RECURSIVE {BRACKET}, {POINTS}, {_BRACKETS.replace('coalesce(GUESS, ', 'coalesce(NULL, ')} {_SOLVED}",
    "crf_solve_brent": f"WITH RECURSIVE {BRACKET}, {POINTS}, {_BRACKETS.replace('GUESS', IQ)} {_SOLVED}",
    "brent_guess": f"""WITH {BRACKET}, last AS (SELECT *, row_number() OVER (PARTITION BY segment_hash, aq_mode, aq_strength, target ORDER BY {SEQ_DESC}) AS n FROM samples QUALIFY n <= 3),
      h AS (SELECT segment_hash, aq_mode, aq_strength, target, list(crf ORDER BY n DESC) AS hx, list(vmaf ORDER BY n DESC) AS hy FROM last GROUP BY ALL),
      g AS (SELECT *, coalesce({IQ}, CASE WHEN vmaf_low > vmaf_high THEN crf_low + (vmaf_low - target) * (crf_high - crf_low) / (vmaf_low - vmaf_high) ELSE 0.5::DOUBLE * (crf_low + crf_high) END) AS q FROM bracket JOIN h USING (segment_hash, aq_mode, aq_strength, target) WHERE crf_low IS NOT NULL AND crf_high IS NOT NULL)
      SELECT segment_hash, aq_mode, aq_strength, target, round(least(greatest(q, crf_low + 0.2::DOUBLE * (crf_high - crf_low)), crf_high - 0.2::DOUBLE * (crf_high - crf_low)), 6) AS guess FROM g""",
    **{f"sampler_{m}": _sampler(m) for m in ("sobol", "halton", "lhs", "random")},
}


def _scored_from(rated: str, suffix: str) -> str:
    """CTEs from rated (vmaf, rate, target and more) to scored, their names with a suffix."""
    text = SCORED[SCORED.index("), parts AS (") + 3 :].replace("FROM rated", f"FROM {rated}")
    return re.sub(r"\b(parts|components|raw|scored) AS \(", rf"\g<1>{suffix} AS (", re.sub(r"FROM (parts|components|raw)\b", rf"FROM \g<1>{suffix}", text))


def _turn(i: int, target: float) -> str:
    """CTEs of a target's turn: from all trials so far (so_far{i - 1}) the two best settings, their brackets, ends and probes, to so_far{i}."""
    solve = SOLVE.replace("coalesce(GUESS, ", "coalesce(NULL, ").replace("KEYS", "segment_hash, place, aq_mode, aq_strength, target").replace("BRACKETS", f"ends{i}").replace("FROM solve ", f"FROM solve{i} ").replace("solve AS (", f"solve{i} AS (", 1)
    end = lambda source, crf: f"SELECT b.*, {NEAREST.format(crf)} AS m FROM {source} b JOIN points r USING (segment_hash, aq_mode, aq_strength)"
    probe = lambda source, crf, m, seq: f"SELECT segment_hash, 'libsvtav1' AS encoder, {crf} AS crf, aq_mode, aq_strength, {m}.v AS vmaf, {m}.o AS out_bytes, {i} AS stage, {seq} AS seq FROM {source}"
    return f"""rated_{i} AS MATERIALIZED (
  SELECT *, out_bytes / 1000000.0::DOUBLE AS rate, {target}::DOUBLE AS target FROM so_far{i - 1}
), {_scored_from(f"rated_{i}", f"_{i}")}, settings{i} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY segment_hash ORDER BY value DESC, first) AS place FROM (SELECT segment_hash, target, aq_mode, aq_strength, greatest(0.0::DOUBLE, max(proxy)) AS value, min((stage, seq)) AS first FROM scored_{i} GROUP BY ALL) QUALIFY place <= 2
), samples{i} AS (
  SELECT * FROM rated_{i} QUALIFY row_number() OVER (PARTITION BY segment_hash, aq_mode, aq_strength, crf ORDER BY stage DESC, seq DESC) = 1
), lows{i} AS (
  SELECT *, max(CASE WHEN vmaf >= target THEN crf END) OVER (PARTITION BY segment_hash, aq_mode, aq_strength) AS low FROM samples{i}
), bracket{i} AS (
  SELECT segment_hash, aq_mode, aq_strength, max(CASE WHEN vmaf >= target THEN crf END) AS crf_low, arg_max(vmaf, crf) FILTER (vmaf >= target) AS vmaf_low,
    min(CASE WHEN vmaf < target AND (low IS NULL OR crf > low) THEN crf END) AS crf_high, arg_min(vmaf, crf) FILTER (vmaf < target AND (low IS NULL OR crf > low)) AS vmaf_high FROM lows{i} GROUP BY ALL
), opened{i} AS MATERIALIZED (
  SELECT segment_hash, place, aq_mode, aq_strength, target, crf_low, vmaf_low, crf_high, vmaf_high FROM settings{i} JOIN bracket{i} USING (segment_hash, aq_mode, aq_strength)
), least{i} AS MATERIALIZED ({end(f"(SELECT * FROM opened{i} WHERE crf_low IS NULL)", "20.0::DOUBLE")}
), with_low{i} AS MATERIALIZED (
  SELECT * FROM opened{i} WHERE crf_low IS NOT NULL UNION ALL SELECT * EXCLUDE (m) REPLACE (20.0::DOUBLE AS crf_low, m.v AS vmaf_low) FROM least{i} WHERE m.v >= target
), greatest{i} AS MATERIALIZED ({end(f"(SELECT * FROM with_low{i} WHERE crf_high IS NULL)", "55.0::DOUBLE")}
), ends{i} AS MATERIALIZED (
  SELECT * FROM with_low{i} WHERE crf_high IS NOT NULL UNION ALL SELECT * EXCLUDE (m) REPLACE (55.0::DOUBLE AS crf_high, m.v AS vmaf_high) FROM greatest{i} WHERE m.v < target
), {solve}, so_far{i} AS MATERIALIZED (
  SELECT * FROM so_far{i - 1} UNION ALL BY NAME {probe(f"least{i}", "20.0::DOUBLE", "m", "place * 10")} UNION ALL BY NAME {probe(f"greatest{i}", "55.0::DOUBLE", "m", "place * 10 + 1")}
  UNION ALL BY NAME SELECT segment_hash, 'libsvtav1' AS encoder, c AS crf, aq_mode, aq_strength, v AS vmaf, o AS out_bytes, {i} AS stage, place * 10 + 1 + i AS seq FROM solve{i} WHERE i > 0
)"""


def search(design: str) -> str:
    """The search over all segments: design (CTEs up to design: encoder, crf, aq_mode, aq_strength, seq) for all targets, then target by
    target the crf solve at the two best settings by all trials so far, and the best trial of those that there were by then."""
    return f"""WITH RECURSIVE {TRIALS}, {TARGETS}, {POINTS}, {design}, so_far0 AS MATERIALIZED (
  SELECT * EXCLUDE (m), m.v AS vmaf, m.o AS out_bytes, 0 AS stage FROM (
    SELECT s.segment_hash, d.encoder, d.crf, d.aq_mode, d.aq_strength, d.seq, {NEAREST.format("d.crf")} AS m FROM (SELECT DISTINCT segment_hash, encoder FROM trials) s JOIN design d ON s.encoder = d.encoder
    JOIN points r ON r.segment_hash = s.segment_hash AND r.aq_mode = d.aq_mode AND r.aq_strength = d.aq_strength)
), {", ".join(_turn(i, t) for i, t in enumerate((85.0, 89.0, 93.0), start=1))}, rated2 AS MATERIALIZED (
  SELECT *, out_bytes / 1000000.0::DOUBLE AS rate FROM so_far3 JOIN (SELECT target, row_number() OVER (ORDER BY target) AS turn FROM targets) ON stage <= turn
), {_scored_from("rated2", "2")}
SELECT segment_hash, target, feasible, crf, aq_mode, aq_strength, vmaf, round(score, 6) AS score FROM scored2 QUALIFY row_number() OVER (PARTITION BY segment_hash, target ORDER BY feasible DESC, CASE WHEN feasible THEN score ELSE vmaf END DESC, stage, seq) = 1"""


#: The screen of the one encoder that the trials have: eight settings by two inner crfs.
_SCREEN = """design AS (
  SELECT 'libsvtav1' AS encoder, crf, aq_mode, aq_strength, row_number() OVER (ORDER BY aq_mode, aq_strength, crf) AS seq FROM (SELECT unnest([31.7::DOUBLE, 43.3::DOUBLE]) AS crf), (SELECT unnest([0, 1]) AS aq_mode), (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE]) AS aq_strength)
)"""
ORACLES |= {"search_screen": search(_SCREEN), **{f"search_{m}": search(sampled(m, 12).replace("points AS (", "design AS (")) for m in ("halton", "sobol")}}

_FINAL = search(_SCREEN).rsplit("\nSELECT segment_hash, target, feasible", 1)[0]
ORACLES |= {
    "trial_counts": f"WITH {TRIALS} SELECT encoder, count(*) AS written, count(DISTINCT (segment_hash, round_even(crf, 1), aq_mode, round_even(aq_strength, 2))) AS stored FROM trials GROUP BY encoder",
    "even_trials": f"WITH {TRIALS}, per AS (SELECT segment_hash, list_sort(list(DISTINCT crf)) AS c FROM trials GROUP BY ALL) SELECT segment_hash, array_to_string(list_transform(CASE WHEN len(c) <= 4 THEN c ELSE list_transform(range(0, 4), lambda i: c[CAST(round_even(i * (len(c) - 1) / 3.0::DOUBLE, 0) AS INT) + 1]) END, lambda x: format('{{:g}}', x)), ',') AS crfs FROM per",
    "trial_store": f"""WITH {TRIALS}, {_UPSERT}, put AS (SELECT * FROM keyed WHERE l_suppkey % 3 < 2 OR l_partkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY l_suppkey % 3 DESC, {SEQ_DESC}) = 1)
      SELECT segment_hash, count(*) AS n_stored, round(sum(vmaf), 4) AS vmaf, CAST(sum(out_bytes) AS BIGINT) AS out_bytes FROM put GROUP BY segment_hash""",
    "stored_trials": f"""WITH {TRIALS}, last AS (SELECT segment_hash, crf, aq_mode, aq_strength, vmaf, l_suppkey FROM trials QUALIFY row_number() OVER (PARTITION BY segment_hash, crf, aq_mode, aq_strength ORDER BY {SEQ_DESC}) = 1),
      off AS (SELECT DISTINCT segment_hash, crf + CASE WHEN l_orderkey % 3 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS crf, aq_mode, aq_strength FROM trials),
      asked AS (SELECT segment_hash, {_TENTHS.format("least(greatest(crf, 20.0::DOUBLE), 55.0::DOUBLE)")} AS crf, aq_mode, aq_strength FROM off),
      known AS (SELECT segment_hash, crf, aq_mode, aq_strength, vmaf FROM trials WHERE l_suppkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY segment_hash, crf, aq_mode, aq_strength ORDER BY {SEQ_DESC}) = 1),
      points AS (SELECT segment_hash, aq_mode, aq_strength, list({{'c': crf, 'v': vmaf}}) AS p FROM last GROUP BY ALL),
      met AS (SELECT a.*, k.vmaf AS known, list_min(list_transform(p, lambda x: {{'apart': abs(x.c - a.crf), 'c': x.c, 'v': x.v}})).v AS near FROM asked a LEFT JOIN known k USING (segment_hash, crf, aq_mode, aq_strength) JOIN points USING (segment_hash, aq_mode, aq_strength))
      SELECT segment_hash, count(known) AS n_stored, count(*) - count(known) AS n_measured, round(sum(coalesce(known, near)), 4) AS vmaf, CAST(0 AS BIGINT) AS n_again, round(sum(coalesce(known, near)), 4) AS vmaf_again FROM met GROUP BY segment_hash""",
    "search_results": f"""{_FINAL}, counted AS (SELECT segment_hash, target, bool_or(feasible) AS feasible, count(*) AS n_trials, count(DISTINCT (crf, aq_mode, aq_strength)) AS n_encodes, least(5, count(*) FILTER (feasible)) AS n_top FROM scored2 GROUP BY ALL),
      ranked AS (SELECT segment_hash, target, score, row_number() OVER (PARTITION BY segment_hash, target ORDER BY feasible DESC, CASE WHEN feasible THEN score ELSE vmaf END DESC, stage, seq) AS n FROM scored2)
      SELECT c.segment_hash, c.target, c.feasible, n_trials, n_encodes, n_top, round(b.score, 6) AS score, round(l.score, 6) AS last_score FROM counted c JOIN ranked b ON b.segment_hash = c.segment_hash AND b.target = c.target AND b.n = 1 LEFT JOIN ranked l ON l.segment_hash = c.segment_hash AND l.target = c.target AND l.n = c.n_top AND c.n_top > 0""",
}
