import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import LENGTHS, by_series, telemetry_pdf

from shotstream.operators import sequence as sq
from shotstream.schema import SERIES_KEY

PDF = telemetry_pdf(LENGTHS)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(PDF).repartition(4)


def test_positions_count_from_zero(df, limits):
    got = by_series(sq.with_position(df, SERIES_KEY, ["ts_unix_ns"], limits).toPandas())
    want = by_series(PDF).groupby(["shot_id", "channel_name"]).cumcount()
    assert got["pos"].tolist() == want.tolist()


@pytest.mark.parametrize("lookback", [1, 5, 16, 49])
def test_every_row_is_owned_once_and_sees_its_predecessors(df, limits, lookback):
    seq = sq.chunks(df, SERIES_KEY, ["ts_unix_ns"], lookback, limits)
    frame = seq.window.rowsBetween(-lookback, 0)
    rows = seq.rows.withColumn("n", F.count("value").over(frame)).withColumn(
        "total", F.sum("value").over(frame)
    )
    got = by_series(seq.owned(rows).toPandas())
    want = by_series(PDF)
    rolled = want.groupby(["shot_id", "channel_name"])["value"].rolling(lookback + 1, min_periods=1)
    assert len(got) == len(want)
    assert got["n"].tolist() == rolled.count().astype(int).tolist()
    pd.testing.assert_series_equal(
        got["total"], rolled.sum().reset_index(drop=True), check_names=False
    )


def test_a_measured_key_is_not_counted_again(df):
    most = int(PDF.groupby(["shot_id", "channel_name"]).size().max())
    for rows, fits in ((most, True), (most - 1, False)):
        known = sq.measured(df, SERIES_KEY, sq.Limits(key_rows=rows))
        assert sq.measured(None, SERIES_KEY, known) is known
        assert sq.largest_key_fits(None, SERIES_KEY, known) is fits
    assert sq.largest_key_fits(df, ["shot_id"], known) == (PDF.groupby("shot_id").size().max() < most)
    assert sq.measured(df.limit(0), SERIES_KEY, sq.Limits()).known == ((tuple(SERIES_KEY), 0),)


def test_chunks_are_bounded(df):
    tiny = sq.Limits(key_rows=1, slice_rows=7, chunk_rows=16)
    seq = sq.chunks(df, SERIES_KEY, ["ts_unix_ns"], 10, tiny)
    assert seq.rows.groupBy(*seq.parts).count().agg(F.max("count")).first()[0] <= 26


def test_carry_forward_takes_the_latest_value(df, limits):
    sparse = F.when(F.col("value") > 80, F.col("value"))
    got = by_series(
        sq.carry_forward(df, SERIES_KEY, ["ts_unix_ns"], {"seen": sparse}, limits).toPandas()
    )
    want = by_series(PDF)
    want["seen"] = want["value"].where(want["value"] > 80)
    want["seen"] = want.groupby(["shot_id", "channel_name"])["seen"].ffill()
    pd.testing.assert_series_equal(got["seen"], want["seen"])


def test_running_max_excludes_the_row_itself(df, limits):
    got = by_series(
        sq.running_max_before(df, SERIES_KEY, ["ts_unix_ns"], "value", "m", limits).toPandas()
    )
    want = by_series(PDF)
    want["m"] = want.groupby(["shot_id", "channel_name"])["value"].transform(
        lambda s: s.cummax().shift()
    )
    pd.testing.assert_series_equal(got["m"], want["m"])


@pytest.mark.parametrize("broadcast_rows", [100, 1])
def test_dimension_join_keeps_every_fact_once(spark, df, broadcast_rows):
    dim = spark.createDataFrame([("hot", 1), ("b", 2)], "shot_id string, tag int")
    joined = sq.dimension_join(df, dim, ["shot_id"], ["ts_unix_ns"], broadcast_rows=broadcast_rows)
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert ("_salt" in plan) == (broadcast_rows == 1)
    assert joined.count() == len(PDF)
    tags = {r.shot_id: r.tag for r in joined.select("shot_id", "tag").distinct().collect()}
    assert tags == {"hot": 1, "b": 2, "c": None, "d": None}


def test_dimension_join_spreads_a_hot_key(spark, df):
    hot = df.filter("shot_id = 'hot'").withColumn(
        "_salt", F.pmod(F.xxhash64("ts_unix_ns"), F.lit(32))
    )
    assert hot.select("_salt").distinct().count() > 16


def test_rows_with_null_keys_are_kept(spark, limits):
    rows = [(k, i, float(i)) for k in (None, "", "a") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, t bigint, value double")
    placed = sq.with_position(df, ["k"], ["t"], limits)
    assert sorted((r.k or repr(r.k), r.pos) for r in placed.collect()) == sorted(
        (k or repr(k), i) for k, i, _ in rows
    )
    seen = sq.running_max_before(df, ["k"], ["t"], "value", "m", limits)
    assert seen.count() == 90 and seen.filter("m is null").count() == 3
    carried = sq.carry_forward(df, ["k"], ["t"], {"c": F.when(F.col("t") == 0, F.col("value"))}, limits)
    assert carried.filter("c = 0").count() == 90
