"""Cut series must give exactly what whole series give, for any segment width."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.features import KEYS, market_features
from tidemark.operators.ordering import dense_position, group_median, position, rising, rising_text, weighted_prefix
from tidemark.operators.bars import with_volume_delta
from tidemark.operators.segments import SEGMENT, KeyedSeries, Segmentation
from tidemark.registry.views import quotes_dense


def collected(df, columns, digits=9):
    rows = df.select(*columns).collect()
    rounded = (tuple(round(v, digits) if isinstance(v, float) else v for v in row) for row in rows)
    return sorted(rounded, key=repr)


@pytest.mark.parametrize("minutes", [5, 60, 240])
def test_features_do_not_depend_on_the_cut(spark, sf_dir, minutes):
    samples = quotes_dense(spark, sf_dir)
    benchmark = samples.filter("symbol = 'view'")
    columns = [
        "event_id", "volume_delta", "vwap", "ema", "opening_range_high", "opening_range_low",
        "gap_pct", "rvol", "volume_acceleration", "volatility", "market_relative_strength",
    ]
    results = [
        collected(
            market_features(
                samples,
                market=benchmark,
                previous_close=F.lit(100.0),
                segmentation=Segmentation(width),
            ),
            columns,
            8,
        )
        for width in (None, minutes)
    ]
    assert len(results[0]) == samples.count()
    assert results[0] == results[1]


@pytest.mark.parametrize("minutes", [None, 1, 30])
def test_ema_equals_the_recursion(spark, minutes):
    rows = [("a", i * 7_000_000, float((i * 37) % 101)) for i in range(1500)]
    df = spark.createDataFrame(rows, "symbol string, t long, p double")
    series = KeyedSeries(df, ["symbol"], ["t"], Segmentation(minutes))
    got = {r.t: r.ema for r in series.ema("ema", F.col("p"), 9).finish().collect()}
    mean = rows[0][2]
    for _, t, p in rows:
        mean = p if t == 0 else 0.8 * mean + 0.2 * p
        assert got[t] == pytest.approx(mean, abs=1e-9)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("minutes", [None, 1, 15])
def test_asof_equals_merge_asof(spark, direction, minutes):
    import pandas as pd

    left = [(k, i * 13 % 997, i) for i in range(400) for k in ("x",)]
    right = [(k, i * 29 % 911, float(i)) for i in range(120) for k in ("x", "y")]
    to_time = F.timestamp_seconds(F.col("s"))
    l_df = spark.createDataFrame(left, "k string, s long, id long").withColumn("at", to_time)
    r_df = (
        spark.createDataFrame(right, "k string, s long, price double")
        .withColumn("r_at", to_time)
        .drop("s")
    )
    got = {
        r.id: r.price
        for r in asof_join(
            l_df, r_df, by=["k"], left_time="at", right_time="r_at", values=["price"],
            direction=direction, segmentation=Segmentation(minutes),
        ).collect()
    }
    lp = pd.DataFrame(left, columns=["k", "s", "id"]).sort_values("s")
    rp = pd.DataFrame(right, columns=["k", "s", "price"]).sort_values("s")
    want = pd.merge_asof(lp, rp, on="s", by="k", direction=direction).set_index("id")["price"]
    assert len(got) == 400
    for key, value in got.items():
        assert (value is None and pd.isna(want[key])) or value == want[key]


def segments_of(df, keys, cut):
    return cut.attach(df, F.col("t")).groupBy(*keys, SEGMENT).count()


def test_bounds_follow_the_counts_of_each_key(spark):
    # One key holds nine tenths of the rows, most of them within one minute.
    rows = [("hot", i * 1_000) for i in range(40_000)] + [("hot", i * 60_000_000) for i in range(5_000)]
    rows += [(f"k{i % 1000}", i * 60_000_000) for i in range(5_000)] + [(None, i * 60_000_000) for i in range(700)]
    df = spark.createDataFrame(rows, "symbol string, t long")
    for limit in (500, 5_000):
        cut = Segmentation.for_input(df, ["symbol"], F.col("t"), rows=limit)
        parts = segments_of(df, ["symbol"], cut).collect()
        assert max(row["count"] for row in parts) <= limit * 1.6  # rows are not spread evenly inside a minute
        calm = [row for row in parts if row.symbol not in ("hot", None)]
        assert len(calm) == 1000 and {row[SEGMENT] for row in calm} == {0}
        assert sum(row.symbol is None for row in parts) == (2 if limit == 500 else 1)
        assert cut.bounds.count() == (2 if limit == 500 else 1)
        # A segment is a range of the order column.
        ranges = cut.attach(df.where("symbol = 'hot'"), F.col("t")).groupBy(SEGMENT).agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy(SEGMENT).collect()
        assert all(x.b < y.a for x, y in zip(ranges, ranges[1:]))
    whole = Segmentation.for_input(df, ["symbol"], F.col("t"))
    assert whole.bounds.count() == 0
    numbered = spark.range(3_000).select(F.lit("a").alias("symbol"), F.col("id").alias("t"))
    ordinals = Segmentation.for_input(numbered, ["symbol"], F.col("t"), cell=1, rows=1_000)
    assert {row["count"] for row in segments_of(numbered, ["symbol"], ordinals).collect()} <= {999, 1000, 1001, 1}
    none = Segmentation.for_input(df.limit(0), ["symbol"], F.col("t"))
    assert segments_of(df.limit(0), ["symbol"], none).count() == 0


def test_counted_cuts_change_no_result(spark, sf_dir):
    samples = quotes_dense(spark, sf_dir)
    keys = ["symbol", "session_date"]
    columns = ["event_id", "volume_delta", "vwap", "ema", "opening_range_high", "gap_pct", "volatility"]
    results = []
    for limit in (7, 40, 1_000_000):
        cut = Segmentation.for_input(samples, keys, F.unix_micros("received_at"), rows=limit)
        df = market_features(samples, previous_close=F.lit(100.0), segmentation=cut)
        results.append(collected(df, columns, 8))
    assert cut.bounds.count() == 0 and results[0] == results[1] == results[2]


def test_calm_keys_cost_no_carry(spark, sf_dir):
    """Where no key is cut, the executed plan has one path with one shuffle of the rows."""
    samples = quotes_dense(spark, sf_dir)
    df = with_volume_delta(samples)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") <= 2 and "Union" not in final and "SortMergeJoin" not in final


def test_small_left_side_reduces_a_large_right_side(spark):
    right = spark.range(50_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("k"),
        F.timestamp_micros(F.col("id") * 1_000_000).alias("at"),
        F.col("id").alias("v"),
    )
    left = spark.range(30).select(F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * 100_000_000).alias("when"))
    got = asof_join(left, right, by=["k"], left_time="when", right_time="at", values=["v"])
    rows = got.collect()
    assert len(rows) == 30
    for row in rows:
        second = int(row.when.timestamp())
        want = second if second % 10 else second - 1
        assert row.v == (want if want >= 0 else None)


def test_positions_and_medians_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else "cold", (i * 7919) % 500, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, id long")
    order = [F.col("v").desc(), F.col("id").asc()]
    for limit in (1_000_000, 50):
        along = -rising(F.col("v").cast("double"))
        got = {r.id: r.position for r in position(df, ["g"], order, along=along, rows=limit).collect()}
        for group in ("hot", "cold"):
            want = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
            assert [got[r[2]] for r in want] == list(range(1, len(want) + 1))
        medians = {r.g: r.median for r in group_median(df, ["g"], F.col("v"), rows=limit).collect()}
        from statistics import median

        assert medians == {
            g: median(r[1] for r in rows if r[0] == g) for g in ("hot", "cold")
        }
        ranks = {
            (r.g, r.v): r.dense_rank
            for r in dense_position(df, ["g"], "v", rows=limit).collect()
        }
        values = sorted({r[1] for r in rows if r[0] == "hot"})
        assert [ranks["hot", v] for v in values] == list(range(len(values)))
        prefix = weighted_prefix(
            df, ["g"], [F.col("id").asc()], F.lit(2), along=F.col("id"), name="upto", rows=limit
        )
        assert prefix.filter("g = 'cold'").agg(F.max("upto")).first()[0] == 2000
    assert KEYS == ["symbol", "session_date"]


def test_longs_that_follow_values(spark):
    import math
    import random

    pick = random.Random(4)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, 1.0, math.nextafter(1, 0), math.nextafter(1, 2)]
    values += [math.nextafter(2.0**k, 0) for k in range(-40, 60)] + [2.0**k for k in range(-40, 60)]
    values += [pick.uniform(-1, 1) * 10 ** pick.randrange(-20, 20) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.k for r in df.select("v", rising(F.col("v")).alias("k")).orderBy("v").collect()]
    assert got == sorted(got) and len(set(got)) > 2000
    texts = ["2024-01-02", "2024-01-03", "2023-12-31", "2024", "", "2024-1", "20x4", "20y3", "~", "2024-01-02T10", "é", " 1", "2026-001"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [r.k for r in df.select("t", rising_text(F.col("t")).alias("k")).orderBy("t").collect()]
    assert got == sorted(got) and len(set(got)) >= 10
