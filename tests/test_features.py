import math

import numpy as np
import pandas as pd
import pytest
from series import LENGTHS, by_series, telemetry_pdf

from shotstream.operators import ewm, features, ingest, points, robust, spectral
from shotstream.operators.sequence import Limits
from shotstream.schema import POINT

PDF = telemetry_pdf(LENGTHS)
GROUP = ["shot_id", "channel_name"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(PDF).repartition(4)


def each_series(function):
    want = by_series(PDF)
    parts = [function(g["value"].reset_index(drop=True)) for _, g in want.groupby(GROUP)]
    return np.concatenate([np.asarray(p, dtype=float) for p in parts])


def column(frame, name):
    return by_series(frame.toPandas())[name].to_numpy()


def literal(spark, values):
    rows = [("s", i + 1, "ip", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "shot_id string, ts_unix_ns bigint, channel_name string, value double"
    )


def test_buffer_drops_the_oldest(spark):
    last = features.online_features(literal(spark, range(1, 7)), [5]).orderBy("ts_unix_ns").collect()[-1]
    assert (last.min_w5, last.max_w5, last.mean_w5) == (2.0, 6.0, 4.0)


def test_five_values_in_a_ten_sample_window(spark):
    rows = features.online_features(literal(spark, range(1, 6)), [100]).orderBy("ts_unix_ns").collect()
    last, first = rows[-1], rows[0]
    assert (last.mean_w100, last.min_w100, last.max_w100, last.last_w100) == (3.0, 1.0, 5.0, 5.0)
    assert last.std_w100 == pytest.approx(math.sqrt(2.5))
    assert last.slope_w100 == pytest.approx(0.04) and last.delta_w100 == 1.0
    assert (first.std_w100, first.slope_w100, first.delta_w100) == (0.0, 0.0, 0.0)


def test_delta_reaches_past_a_window_of_one(spark, limits):
    rows = features.online_features(literal(spark, [5, 7, 4]), [1], limits=limits)
    assert [r.delta_w1 for r in rows.orderBy("ts_unix_ns").collect()] == [0.0, 2.0, -3.0]


def test_unknown_statistic(df):
    with pytest.raises(ValueError):
        features.online_features(df, [5], ["median"])


def test_online_against_pandas(df, limits):
    got = features.online_features(df, [5, 20], limits=limits)
    for n in (5, 20):
        for stat, f in {
            "mean": lambda s: s.rolling(n, min_periods=1).mean(),
            "std": lambda s: s.rolling(n, min_periods=1).std().fillna(0),
            "min": lambda s: s.rolling(n, min_periods=1).min(),
            "max": lambda s: s.rolling(n, min_periods=1).max(),
            "last": lambda s: s,
            "delta": lambda s: s.diff().fillna(0),
            "slope": lambda s: (s - s.shift(n - 1).fillna(s.iloc[0])) / n,
        }.items():
            np.testing.assert_allclose(column(got, f"{stat}_w{n}"), each_series(f), atol=1e-9)


def trend(series, n):
    out = []
    for i in range(len(series)):
        window = series.to_numpy()[max(0, i - n + 1) : i + 1]
        out.append(np.polyfit(np.arange(len(window)), window, 1)[0] if len(window) > 1 else 0.0)
    return out


def test_offline_trend_against_polyfit(df, limits):
    got = features.offline_features(df, [12], rate_hz=1000, limits=limits)
    np.testing.assert_allclose(column(got, "slope_w12"), each_series(lambda s: trend(s, 12)), atol=1e-7)


def test_offline_windows_follow_the_rate(df):
    got = features.offline_features(df, [50], rate_hz=200, stats=["mean", "slope", "slope_ep"])
    want = each_series(lambda s: s.rolling(10, min_periods=1).mean())
    np.testing.assert_allclose(column(got, "mean_w50"), want, atol=1e-9)
    slopes = each_series(lambda s: np.array(trend(s, 10)) * 0.2)
    np.testing.assert_allclose(column(got, "slope_w50"), slopes, atol=1e-7)


def test_no_leak_between_shots(spark, df):
    alone = features.online_features(df.filter("shot_id = 'b'"), [20])
    together = features.online_features(df, [20]).filter("shot_id = 'b'")
    pd.testing.assert_frame_equal(by_series(alone.toPandas()), by_series(together.toPandas()))


@pytest.mark.parametrize("alpha", [0.01, 0.2, 0.9])
def test_ewm_against_pandas(df, limits, alpha):
    got = by_series(ewm.ewm_zscore(df, alpha, limits).toPandas())
    mean = each_series(lambda s: s.ewm(alpha=alpha, adjust=False).mean())
    std = each_series(lambda s: s.ewm(alpha=alpha, adjust=False).std().fillna(1.0))
    values = by_series(PDF)["value"].to_numpy()
    np.testing.assert_allclose(got["ema"], mean, rtol=1e-10)
    np.testing.assert_allclose(got["ema_std"], std, rtol=1e-8)
    np.testing.assert_allclose(got["zscore"], (values - mean) / (std + 1e-9), rtol=1e-7, atol=1e-9)


def test_ewm_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    values = 1e6 + rng.normal(0, 1, 30_000).cumsum()
    frame = pd.DataFrame(
        {"shot_id": "s", "channel_name": "ip", "ts_unix_ns": np.arange(1, 30_001), "value": values}
    )
    df = spark.createDataFrame(frame)
    limits = Limits(key_rows=1, slice_rows=1_000, chunk_rows=1_000)
    got = by_series(ewm.ewm_zscore(df, 0.01, limits).toPandas())
    series = pd.Series(values)
    np.testing.assert_allclose(got["ema"], series.ewm(alpha=0.01, adjust=False).mean(), rtol=1e-12)
    std = series.ewm(alpha=0.01, adjust=False).std().fillna(1.0)
    np.testing.assert_allclose(got["ema_std"], std, rtol=1e-6)


def test_ewm_of_a_constant(spark):
    got = ewm.ewm_zscore(literal(spark, [19.3] * 40)).orderBy("ts_unix_ns").toPandas()
    assert got["ema_std"].tolist() == [1.0] + [0.0] * 39
    assert (got["zscore"] == 0).all()


def slow_anomaly(series, size):
    values, out = series.to_numpy(), []
    for i in range(len(values)):
        window = values[max(0, i - size + 1) : i + 1]
        median = np.median(window)
        mad = np.median(np.abs(window - median))
        out.append(abs(values[i] - median) / (mad + 1e-9) if len(window) >= 10 and mad > 0 else 0.0)
    return out


@pytest.mark.parametrize("size", [1000, 25])
def test_anomaly_against_a_loop(df, limits, size):
    got = robust.anomaly(df, size, limits)
    np.testing.assert_allclose(column(got, "anomaly"), each_series(lambda s: slow_anomaly(s, size)))


def test_anomaly_of_a_constant_is_zero(spark):
    got = robust.anomaly(literal(spark, [3.0] * 20)).toPandas()
    assert (got["anomaly"] == 0).all()


def slow_spectrum(series, rate=1000.0):
    values = series.to_numpy()
    size = min(1000, len(values) // 10)
    energy, peak = [], []
    for i in range(len(values)):
        window = values[max(0, i - size + 1) : i + 1] if size else values[:0]
        if len(window) >= 32:
            power = np.abs(np.fft.rfft(window)) ** 2
            energy.append(power.sum())
            peak.append((np.argmax(power[1:]) + 1) * rate / len(window))
        else:
            energy.append(0.0)
            peak.append(0.0)
    return energy, peak


def test_spectrum_against_fft(df, limits):
    energy = column(spectral.spectral_energy(df, limits), "energy")
    np.testing.assert_allclose(energy, each_series(lambda s: slow_spectrum(s)[0]), rtol=1e-9)
    assert (energy > 0).any()
    peak = column(spectral.dominant_frequency(df, limits=limits), "dominant_freq")
    np.testing.assert_allclose(peak, each_series(lambda s: slow_spectrum(s)[1]))


def test_tasks_of_whole_series_hold_a_bounded_number_of_rows(df):
    small = Limits(task_rows=20)
    made = spectral.spectral_energy(df, small)
    assert made.rdd.getNumPartitions() >= len(PDF) // 20
    np.testing.assert_allclose(column(made, "energy"), column(spectral.spectral_energy(df), "energy"), rtol=1e-12)


def test_spectrum_reads_its_source_twice(spark, df):
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    spectral.dominant_frequency(df.mapInArrow(told, df.schema)).collect()
    assert read.value <= 2 * len(PDF)


def test_vectors_hold_the_channels_of_their_point(spark):
    rows = [
        ("s", 1, [("ip", 1.0, "good"), ("ne", 5.0, "good")]),
        ("s", 2, [("ip", 3.0, "good")]),
    ]
    pts = ingest.with_missing_ratio(spark.createDataFrame(rows, POINT))
    long = points.explode_points(pts, "missing_ratio")
    made = features.feature_vectors(features.online_features(long, [50, 200]), [50, 200])
    got = {(r.ts_unix_ns, r.window_ms): r.features for r in made.collect()}
    assert len(got) == 4 and len(got[1, 50]) == 15 and len(got[2, 200]) == 8
    assert got[2, 50]["ip_mean_w50"] == 2.0 and got[2, 50]["missing_ratio"] == pytest.approx(0.8)
    merged = features.feature_vectors(
        features.online_features(long, [50, 200]), [50, 200], merge_windows=True
    )
    sizes = {r.ts_unix_ns: len(r.features) for r in merged.collect()}
    assert sizes == {1: 29, 2: 15}


def test_all_features_has_every_sample_once(df, limits):
    got = features.all_features(df, [20], limits=limits)
    assert got.count() == len(PDF)
    assert got.filter("zscore is null or anomaly is null").count() == 0
