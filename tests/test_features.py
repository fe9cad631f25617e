"""Feature values on hand-made series, against plain numpy or by hand."""

import math
from collections import Counter

import numpy as np
import pytest

from daypanel.operators import features as X
from daypanel.plans.standins import SERIES as PANEL
from daypanel.plans.standins import event_panel

SERIES = {
    "zero": [0.0] * 24,
    "constant": [3.0] * 24,
    "alternating": [0.0, 1.0] * 12,
    "rising": [float(i) for i in range(24)],
    "one_peak": [0.0] * 10 + [5.0] + [0.0] * 13,
    "tied_top": [1.0, 7.0, 2.0, 7.0, 0.0, 3.0, 3.0, 9.0, 9.0, 1.0, 4.0, 4.0],
    "len1": [2.0],
    "len2": [1.0, 4.0],
    "len3": [1.0, 3.0, 2.0],
    "len10": [float(i % 4) for i in range(10)],
    "long": [float((i * i * 7 + 3 * i) % 101) for i in range(130)],
    "tenths": [0.1] * 11,
}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, v) for k, v in SERIES.items()]
    df = spark.createDataFrame(rows, "name string, series array<double>")
    return {r["name"]: r.asDict() for r in X.series_features(df, ["name"]).collect()}


def same(a, b):
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return a is None
    return a is not None and a == pytest.approx(b, abs=1e-9)


def test_wide_features_need_no_exchange_of_their_own(spark, small):
    panel = event_panel(spark, small)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    some = ["mean", "maximum", "quantile__q_0.1"]
    wide = X.pivot_features(X.extract_features(panel, "user_id", PANEL, some), "user_id", PANEL)
    assert exchanges(wide) == exchanges(panel) == 2
    assert len(wide.columns) == 1 + 3 * len(PANEL) and wide.count() == panel.count()


def test_every_feature_is_listed_once():
    assert len(set(X.ALL_FEATURES)) == len(X.ALL_FEATURES) == 71


def test_names_and_count(spark):
    assert len(X.ALL_FEATURES) == 71 == len(set(X.ALL_FEATURES))
    assert list(X.feature_columns()) == X.ALL_FEATURES


@pytest.mark.parametrize("name", SERIES)
def test_moments_and_quantiles(values, name):
    x, v = np.array(SERIES[name]), values[name]
    assert same(v["mean"], x.mean()) and same(v["variance"], x.var()) and same(v["median"], float(np.median(x)))
    for q in X.QUANTILES:
        assert same(v[f"quantile__q_{q}"], float(np.quantile(x, q)))
    assert same(v["absolute_sum_of_changes"], float(np.abs(np.diff(x)).sum()))
    if len(x) > 1:
        assert same(v["linear_trend__attr_slope"], float(np.polyfit(np.arange(len(x)), x, 1)[0]))


@pytest.mark.parametrize("name", SERIES)
def test_peaks_by_definition(values, name):
    x = SERIES[name]
    for n in X.PEAK_SUPPORTS:
        inner = range(n, len(x) - n)
        expected = sum(
            all(x[i] > x[i - j] and x[i] > x[i + j] for j in range(1, n + 1)) for i in inner
        )
        assert values[name][f"number_peaks__n_{n}"] == expected, n


@pytest.mark.parametrize("name", SERIES)
def test_chunks_by_numpy(values, name):
    x = np.array(SERIES[name])
    energy = float((x**2).sum())
    for i, part in enumerate(np.array_split(x, 10)):
        expected = float((part**2).sum()) / energy if energy else None
        assert same(values[name][f"energy_ratio_by_chunks__num_segments_10__segment_focus_{i}"], expected)


@pytest.mark.parametrize("name", SERIES)
def test_order_patterns_by_definition(values, name):
    x = SERIES[name]
    seen = Counter(
        tuple(sorted(range(7), key=lambda j: (x[i + j], j))) for i in range(len(x) - 6)
    )
    n = sum(seen.values())
    expected = -sum(c / n * math.log(c / n) for c in seen.values()) if n else None
    assert same(values[name]["permutation_entropy__dimension_7__tau_1"], expected)


@pytest.mark.parametrize("name", SERIES)
def test_runs_and_repeats(values, name):
    x, v = SERIES[name], values[name]
    mu = sum(x) / len(x)

    def longest(hit):
        best = run = 0
        for e in x:
            run = run + 1 if hit(e) else 0
            best = max(best, run)
        return best

    assert v["longest_strike_below_mean"] == longest(lambda e: e < mu)
    assert v["longest_strike_above_mean"] == longest(lambda e: e > mu)
    counts = Counter(x)
    again = [e for e, c in counts.items() if c > 1]
    assert same(v["sum_of_reoccurring_values"], sum(again))
    assert same(v["percentage_of_reoccurring_values_to_all_values"], len(again) / len(counts))
    top = len(x) - 1 - x[::-1].index(max(x))
    assert same(v["last_location_of_maximum"], (top + 1) / len(x))
    assert same(v["first_location_of_minimum"], x.index(min(x)) / len(x))
    largest = sorted(map(abs, x))[-10:]
    assert same(v["mean_n_absolute_max__number_of_maxima_10"], sum(largest) / 10 if len(x) > 10 else None)


def test_edges(values):
    assert values["zero"]["skewness"] == 0 and values["tenths"]["kurtosis"] == 0
    assert values["zero"]["variation_coefficient"] is None
    assert values["len2"]["skewness"] is None and values["len3"]["kurtosis"] is None
    assert values["len1"]["mean_change"] is None and values["len2"]["mean_second_derivative_central"] is None
    assert values["constant"]["cid_ce__normalize_true"] == 0
    assert values["alternating"]["ratio_beyond_r_sigma__r_1"] == 0
    assert values["alternating"]["ratio_beyond_r_sigma__r_0.5"] == 1
    assert values["constant"]["change_quantiles__f_agg_mean__isabs_true__qh_0.8__ql_0.6"] == 0


def test_abridged_short_series_uses_all(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, TS_A array<double>")
    row = X.abridged_features(df, "id", ["TS_A"], tail=30).first()
    assert row["TS_A__mean"] == row["TS_A__mean_30_day"] == 2.0
    assert row["TS_A__variance_30_day"] == pytest.approx(2 / 3)
