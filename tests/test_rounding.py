"""Values that meet a threshold or a half are rounded as in the queries' SQL."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import num as N
from tidemark.operators import masks as M
from tidemark.plans import extras, generated


def test_queue_order_of_values_that_end_in_a_half(spark, tmp_path):
    path = f"{tmp_path}/orders.parquet"
    rows = spark.range(20_000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7_919 % 500_000 / 100 + 1000).alias("o_totalprice"), F.lit("O").alias("o_orderstatus"), F.lit("3-MEDIUM").alias("o_orderpriority"))
    rows.withColumn("o_totalprice", F.round("o_totalprice", 2)).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{path}/*.parquet'")
    want = sorted(con.execute(extras.ORACLE["queue_order"]).fetchall())
    got = extras.queue_order(spark, str(tmp_path)).select("o_orderkey", "place", "reason").collect()
    assert sorted(map(tuple, got)) == want


def test_between_is_rounded_once(spark):
    pick = random.Random(3)
    rows = [(pick.random(), pick.random(), pick.choice([7.1e-15, pick.random(), 1 - 7e-15])) for _ in range(5_000)]
    got = spark.createDataFrame(rows, "l double, h double, d double").select("l", "h", "d", N.between(F.col("l"), F.col("h"), F.col("d")).alias("x")).collect()
    assert all(r.x == math.fma(r.l, 1 - r.d, r.h * r.d) for r in got)


def test_beats_at_the_floor_of_76_frames_count_as_in_sql(spark, tmp_path):
    # 0.68 of 75 is 51 but for its rounding, so that the floor is a frame's own value
    pick = random.Random(11)
    month = 30 * 86_400_000_000
    rows = [(u * 76 + k, u, 1_704_067_200_000_000 + pick.randrange(month), pick.choice(["click", "view", "signup", "purchase"]), round(pick.expovariate(0.02), 2)) for u in range(150) for k in range(76)]
    path = f"{tmp_path}/events.parquet"
    df = spark.createDataFrame(rows, "event_id long, user_id long, us long, event_type string, value double")
    df.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/*.parquet'")
    want = con.execute(f"select user_id, provider, beat_hit_rate from ({generated.ORACLE['estimate_scores']})").fetchall()
    got = generated.estimate_scores(spark, str(tmp_path)).select("user_id", "provider", "beat_hit_rate").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_quantile_ahead_that_is_the_tracks_own(spark):
    # 0.72 of 5 bins and 0.84 of 58 lie between the same two values, at shares that differ by their rounding only
    cents = [3468, 0, 0, 0, 19654, 17724, 9266, 63, 5832, 0, 3352, 2470, 0, 0, 2670, 0, 0, 7269, 0, 0, 0, 2534, 0, 4051, 0, 0, 14232, 9962, 8821]
    cents += [3769, 218, 5941, 0, 0, 0, 12318, 0, 16939, 8302, 1694, 12428, 7726, 5774, 16657, 0, 15486, 6780, 6609, 0, 3012, 0, 13490, 0, 0, 3087, 1559, 1218, 3096]
    bins = spark.createDataFrame([(1, i, c / 100 / 600) for i, c in enumerate(cents)], "u long, i long, rms double")
    assert not M.body_masks(bins, "u", 0.05).where("i = 36").first().placeable


def test_times_of_a_grid_that_end_in_a_half(spark, tmp_path):
    # two days make no tempo, so the times stay: whole numbers of 1,728,000 microseconds and a half, which are millionths and a half
    first = 1_704_067_200_000_000
    rows = [(2 * u + d, u, first + d * 86_400_000_000 + (864_000 + 1_728_000 * (u * 37 + 11 * d) if u else 0), "click", 1.0) for u in range(400) for d in range(2)]
    path = f"{tmp_path}/events.parquet"
    df = spark.createDataFrame(rows, "event_id long, user_id long, us long, event_type string, value double")
    df.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/*.parquet'")
    want = con.execute(f"select user_id, i, t from ({generated.ORACLE['grid_repair']})").fetchall()
    assert sorted(map(tuple, generated.grid_repair(spark, str(tmp_path)).select("user_id", "i", "t").collect())) == sorted(want)
