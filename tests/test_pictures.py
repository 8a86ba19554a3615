from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import pictures

SCHEMA = "clip long, place int, width int, height int, data binary"


def plain_shrunk(frame, width):
    """Every new pixel as the mean of what it covers, pixel by pixel."""
    h, w, c = frame.shape
    if w <= width:
        return frame.astype(float)
    rows = max(2, round(h * width / w))
    out = np.zeros((rows, width, c))
    for y in range(rows):
        for x in range(width):
            total = weight = 0.0
            for i in range(int(y * h / rows), int(np.ceil((y + 1) * h / rows - 1e-9))):
                for j in range(int(x * w / width), int(np.ceil((x + 1) * w / width - 1e-9))):
                    share = (min(i + 1, (y + 1) * h / rows) - max(i, y * h / rows)) * (min(j + 1, (x + 1) * w / width) - max(j, x * w / width))
                    total, weight = total + share * frame[i, j], weight + share
            out[y, x] = total / weight
    return out


def plain_features(frames, width):
    spatial, temporal, motion, luma, spread, colour, before = [], [], [], [], [], [], None
    for f in frames:
        small = np.rint(plain_shrunk(f, width))
        g = small[:, :, 0] if f.shape[2] == 1 else np.floor((small[:, :, 0] * 1868 + small[:, :, 1] * 9617 + small[:, :, 2] * 4899 + 8192) / 16384)
        h, w = g.shape
        at = lambda y, x, g=g, h=h, w=w: g[-y if y < 0 else 2 * h - 2 - y if y >= h else y, -x if x < 0 else 2 * w - 2 - x if x >= w else x]
        lengths = []
        for y in range(h):
            for x in range(w):
                gx = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
                gy = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
                lengths.append(np.hypot(gx, gy))
        spatial.append(np.std(lengths))
        luma.append(g.mean())
        spread.append(g.std())
        shares = [np.unique(small[:, :, c], return_counts=True)[1] / g.size for c in range(f.shape[2])]
        colour.append(np.mean([-(p * np.log2(p)).sum() for p in shares]))
        if before is not None and before.shape == g.shape:
            motion.append(np.abs(g - before).mean() / 255)
            temporal.append(np.abs(g - before).std())
        before = g
    return [np.mean(spatial), np.mean(temporal) if temporal else 0.0, np.percentile(motion, 95) if motion else 0.0, np.mean(luma), np.mean(spread), np.mean(colour)]


@pytest.mark.parametrize("width", [64, 16, 7])
def test_features_are_those_of_a_plain_version(spark, width):
    rng = np.random.default_rng(width)
    clips = {1: [(20, 32, 3)] * 4, 2: [(9, 21, 1)] * 3, 3: [(20, 32, 3), (20, 32, 3), (18, 24, 3), (18, 24, 3)], 4: [(8, 8, 3), (10, 10, 3)]}
    made = {k: [rng.integers(0, 256, s).astype(np.uint8) for s in shapes] for k, shapes in clips.items()}
    rows = [(k, i, f.shape[1], f.shape[0], f.tobytes()) for k, fs in made.items() for i, f in enumerate(fs)]
    odd = [(1, 90, 32, 20, None), (1, 91, 32, 20, b"short"), (2, 92, 0, 0, b"")]
    frames = spark.createDataFrame(rows + odd, SCHEMA)
    about = frames.select("clip").distinct().withColumns({"duration": F.lit(2.0), "pixels_per_frame": F.lit(1000)})
    got = {r.clip: r for r in pictures.scene(frames, about, width).collect()}
    for k, fs in made.items():
        r = got[k]
        assert r.n_frames == len(fs) and r.log_pixels == pytest.approx(3) and r.duration == 2.0
        have = [r.spatial_information, r.temporal_information, r.motion_p95, r.luma_mean, r.luma_std, r.color_complexity]
        assert have == pytest.approx(plain_features(fs, width), rel=2e-3, abs=2e-3)


def test_one_frame_is_an_error(spark):
    frames = spark.createDataFrame([(1, 0, 4, 4, bytes(16))], SCHEMA)
    with pytest.raises(Exception, match="fewer than two frames"):
        pictures.scene(frames, frames.select("clip").withColumns({"duration": F.lit(1.0), "pixels_per_frame": F.lit(16)})).collect()


def test_full_frames_take_milliseconds():
    import time

    frame = np.random.default_rng(1).integers(0, 256, (360, 640, 3)).astype(np.uint8)
    pictures.edge_spread(pictures.grey(pictures.shrunk(frame, 320)))
    began = time.perf_counter()
    for _ in range(5):
        small = pictures.shrunk(frame, 320)
        pictures.edge_spread(pictures.grey(small))
        [pictures.entropy(small[:, :, c]) for c in range(3)]
    assert (time.perf_counter() - began) / 5 < 0.25
