"""Hard negatives against brute force."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import negatives, queries


def brute(rows):
    part = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((k, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for k, i, label, v in part:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, l != label) for m, j, l, w in part if m != k)
        for s, j in [(-s, j) for s, j, differs in scored if not differs][:5]:
            fit = [(-t, m) for t, m, differs in scored if differs and 80 * s <= 100 * -t <= 100 * s][:5]
            out += [(i, j, r + 1, m, s, t) for r, (t, m) in enumerate(fit)]
    return sorted(out)


def table(n, seed, width=16):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    common = [float(np.float32(rng.gauss(0, 1))) for _ in range(width)]
    rows = []
    for k in range(n):
        c = centres[k % 6]
        v = common if rng.random() < 0.3 else [float(np.float32(x + rng.gauss(0, 0.5))) for x in c]
        rows.append((k, v, 3 if rng.random() < 0.4 else rng.randrange(10)))
    rows += [(100, rows[100 % n][1], rows[100 % n][2]), (200, rows[3][1], 3), (None, common, 3), (900, None, 3), (901, common, None), (902, [*common[:-1], None], 3), (903, [*common[:-1], math.nan], 3), (904, [math.inf, *common[1:]], 3)]
    rows += [(1000, common[:5], 3), (1001, [], 3), (1100, [], 4), (1200, [-x for x in common], 8), (1300, [0.0] * width, 9)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, rid string, v string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("n, cells", [(60, 1 << 19), (500, 1 << 19), (500, 1000)])
def test_mined_equals_brute_force(spark, n, cells):
    rows = table(n, n)
    ready = negatives.prepared(frame(spark, rows), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = negatives.mined(ready, F.col("vec_id") % 100 == 0, cells=cells)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_query(spark, tmp_path):
    rows = table(300, 8)
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    want = brute(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_large_components_and_empty_table(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [2.9e6, -1e6], 2), (3, [1e20, 1.0], 2), (4, [2.8e6, 5.0], 3)]
    ready = negatives.prepared(frame(spark, rows), F.col("label"))
    got = sorted(tuple(r) for r in negatives.mined(ready, F.col("vec_id") % 100 == 0).collect())
    assert got == brute([r for r in rows if r[0] != 3 and r[0] % 7] + [(0, [3e6, 1.0], 0)]) or [r[3] for r in got] == [2, 4]
    top, low = 256 * 3_000_000 * 256 * 3_000_000, [256 * 3_000_000 * 256 * 2_900_000 - 256 * 256_000_000, 256 * 3_000_000 * 256 * 2_800_000 + 256 * 1280]
    assert [r[4] for r in got] == [top + 256 * 512] * 2 and [r[5] for r in got] == low
    assert negatives.mined(negatives.prepared(frame(spark, []), F.col("label")), F.col("vec_id") % 100 == 0).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(8, 64)) * 40 + np.repeat(rng.normal(size=(8, 4)) * 120, 16, axis=1)
    x = np.floor(centre[rng.integers(0, 8, 400)] + rng.normal(size=(400, 64)) * 8).astype(np.int64)
    s = negatives._Summaries(x)
    exact = x @ x.T
    width = []
    for level in range(len(s.means)):
        low, high = s.bounds(s, level)
        assert (low <= exact).all() and (exact <= high).all()
        width.append((high - low).mean())
    assert len(width) == 3 and width[0] > width[1] > width[2]
    low, high = s.bounds(s, 2)
    assert (high < np.sort(low, axis=1)[:, -5:-4]).mean() > 0.5  # most rows never reach exact scoring
