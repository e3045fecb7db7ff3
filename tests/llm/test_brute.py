"""Transforms, draws and risks against versions written out by hand."""

import cmath
import math
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sextant.llm import media, quality, sharding


def test_peaks_and_pairs_by_the_sum_of_the_transform():
    rng = np.random.default_rng(8)
    samples = rng.integers(-128, 128, media.FRAME + 3 * media.HOP).astype(np.float32)
    frames = [samples[i : i + media.FRAME] for i in range(0, len(samples) - media.FRAME + 1, media.HOP)]
    window = [0.5 - 0.5 * math.cos(2 * math.pi * n / (media.FRAME - 1)) for n in range(media.FRAME)]

    def power(frame, k):
        return abs(sum(float(x) * w * cmath.exp(-2j * math.pi * k * n / media.FRAME) for n, (x, w) in enumerate(zip(frame, window, strict=True))))

    best = [[max(range(lo, hi), key=lambda k: power(f, k)) for lo, hi in media.BANDS] for f in frames]
    assert media.peaks(samples).tolist() == best
    pairs = sorted(t << 32 | best[t][band] << 20 | best[t + d][band] << 8 | d for d in range(1, media.REACH + 1) for t in range(len(best) - d) for band in range(len(media.BANDS)))
    assert media.fingerprint(samples).tolist() == pairs
    assert media.peaks(np.zeros(media.BLOCK, np.float32)).tolist() == [[-1] * 3] * 3 and len(media.fingerprint(np.zeros(media.BLOCK, np.float32))) == 0


def test_shards_by_every_draw(spark):
    weights = [1.0, 0.0, 2.5, 1.0]

    def winner(key):
        draws = []
        for i, w in enumerate(weights):
            if w:
                h = 42
                for part in (str(key).encode(), struct.pack("<i", i), struct.pack("<i", sharding.SEED)):
                    h = xxhash.xxh64_intdigest(part, h)
                draws.append((-math.log(((h >> 11) + 0.5) / 2**53) / w, i))
        return min(draws)[1]

    found = spark.range(300).select("id", sharding.rendezvous(F.col("id"), weights).alias("shard")).collect()
    assert {r["id"]: r["shard"] for r in found} == {k: winner(k) for k in range(300)}


def test_the_fit_has_the_least_risk_of_many_models():
    rng = np.random.default_rng(3)
    p, u = rng.normal(1.5, 1, (300, 2)), np.concatenate([rng.normal(1.5, 1, (120, 2)), rng.normal(-1.5, 1, (280, 2))])
    model = quality.fit_risk(p, u, 0.3)

    def risk(w, b):
        loss = lambda x, side: np.mean([1 / (1 + math.exp(side * (sum(a * (v - c) / s for a, v, c, s in zip(w, row, model.centre, model.scale, strict=True)) + b))) for row in x])
        return 0.3 * loss(p, 1) + max(0.0, loss(u, -1) - 0.3 * loss(p, -1))

    own = risk(model.weights, model.bias)
    assert all(own <= risk(rng.normal(0, 4, 2), rng.normal(0, 4)) + 1e-3 for _ in range(60))
