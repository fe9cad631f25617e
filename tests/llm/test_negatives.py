"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from daypanel.llm import negatives


def brute(rows, is_anchor, positives=5, k=10, low=30, high=90):
    """rows: (key, label, vector); those that take no part are left out here too."""
    sound = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for n, (key, label, v) in enumerate(sound):
        if not is_anchor(key):
            continue
        others = [(sum(x * y for x, y in zip(v, w, strict=True)), k2, l2) for m, (k2, l2, w) in enumerate(sound) if m != n and len(w) == len(v)]
        first = sorted((-s, k2) for s, k2, l2 in others if l2 == label)[:positives]
        for p, pk in ((-s, k2) for s, k2 in first):
            found = sorted((-s, k2) for s, k2, l2 in others if l2 != label and low * p <= 100 * s <= high * p)[:k]
            out += [(key, pk, r + 1, k2, p, -s) for r, (s, k2) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, anchors=lambda c: c % 4 == 0, **options):
    table = spark.createDataFrame(rows, "`a.b` long, label string, vector array<long>").withColumn("row", F.lit(1)).withColumn("given", F.lit("x"))
    got = negatives.mine_negatives(table, anchors(F.col("`a.b`")), key="a.b", **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def clustered(n, d, seed=0, spread=6):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-60, 60, (8, d))
    of = rng.integers(0, 8, n)
    x = centres[of] + rng.integers(-spread, spread + 1, (n, d))
    return [(i, str(rng.integers(0, 3)), [int(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize(("n", "d", "options"), [
    (300, 64, {"block": 50, "many": 20}),
    (300, 64, {}),
    (200, 20, {"block": 64, "many": 7, "positives": 2, "negatives": 3}),
    (150, 3, {"block": 40}),
    (120, 5, {"low": 0, "high": 100, "negatives": 500}),
])
def test_all_windows(spark, n, d, options):
    rows = clustered(n, d)
    same = {"positives": "positives", "negatives": "k", "low": "low", "high": "high"}
    assert mined(spark, rows, **options) == brute(rows, lambda k: k % 4 == 0, **{same[o]: v for o, v in options.items() if o in same})


def test_odd_rows_ties_and_copies(spark):
    rows = clustered(60, 16)
    rows += [(i + 100, "0", [1] * 16) for i in range(40)] + [(i + 200, "1", [1] * 16) for i in range(40)]
    rows += [(None, "0", [1] * 16), (500, None, [1] * 16), (504, "0", None), (508, "0", [1, None] * 8), (512, "1", [2] * 7), (516, "2", []), (520, "1", [])]
    rows += [(4, "2", [3] * 16), (4, "2", [3] * 16), (524, "0", [0] * 16)]
    assert mined(spark, rows, block=16, many=5) == brute(rows, lambda k: k % 4 == 0)


def test_no_anchors_and_no_rows(spark):
    rows = clustered(20, 8)
    assert mined(spark, rows, lambda c: c < 0) == []
    assert mined(spark, rows, lambda c: F.lit(None).cast("boolean")) == []
    assert mined(spark, [], lambda c: c % 4 == 0) == []


def test_scores_beyond_their_type_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, "x", [1 << 40] * 4), (1, "x", [1 << 40] * 4)])


def test_bounds_hold_at_every_level_and_rule_out_most_pairs_of_clusters():
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 60, (8, 1)) * np.ones((8, 64), np.int64)
    x = (centres[rng.integers(0, 8, 200)] + rng.integers(-4, 5, (200, 64))).astype(np.int64)
    exact = x @ x.T
    means, deviations = negatives.segments(x)
    for n in (1, 2, 4, 8, 16):
        m, s = negatives.coarser(means, deviations, n)
        middle, width = (64 // n) * (m @ m.T), (64 // n) * (s @ s.T)
        assert (np.abs(exact - middle) <= width + 1e-6).all()
        if n == 1:
            # What a threshold at the tenth best score leaves.
            tenth = np.sort(exact, axis=1)[:, -10][:, None]
            assert (middle + width >= tenth).mean() < 0.35
