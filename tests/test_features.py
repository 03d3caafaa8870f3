import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelake.operators.features import daily_activity, trailing, trailing_distinct, user_dynamic, video_feature
from tidelake.operators.ranking import first_n_users, latest_per_key, top_n, trending_snapshot


@pytest.fixture
def rows():
    rng = random.Random(3)
    kinds = ["impression", "impression", "click", "view", "like", "error"]
    return [
        (
            i,
            rng.randrange(3),
            rng.choice([None, 1, 2, 3, 99]),
            str(datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(4 * 1440))),
            rng.choice(kinds),
        )
        for i in range(300)
    ]


def test_user_dynamic_agrees_with_counting(spark, make_log, rows):
    category = {1: "a", 2: "b", 3: "a"}
    videos = spark.createDataFrame(list(category.items()), "video_id long, category string")
    got = {(r.user_id, r.dt): r for r in user_dynamic(make_log(rows), videos).collect()}
    groups = defaultdict(list)
    for r in rows:
        if r[4] != "error":
            day = (datetime.fromisoformat(r[3]) + timedelta(hours=9)).date()
            groups[r[1], day].append(r)
    assert got.keys() == groups.keys()
    for (user, day), events in groups.items():
        row, kinds = got[user, day], Counter(e[4] for e in events)
        assert (row.impressions, row.clicks, row.views, row.likes) == tuple(
            kinds[k] for k in ("impression", "click", "view", "like")
        )
        assert row.distinct_videos == len({e[2] for e in events} - {None})
        liked = Counter(category[e[2]] for e in events if e[2] in category)
        best = max(liked, key=lambda c: (liked[c], c)) if liked else None
        assert row.top_category == best
        assert str(row.last_event) == max(e[3] for e in events)
        assert row.event_timestamp == datetime.combine(day, datetime.min.time()) + timedelta(hours=15)
        want = kinds["click"] / kinds["impression"] if kinds["impression"] else None
        assert row.ctr == want


def test_one_day_equals_its_slice_of_all_days(spark, make_log, rows):
    videos = spark.createDataFrame([(1, "a")], "video_id long, category string")
    log, day = make_log(rows), date(2024, 1, 2)
    one = sorted(map(tuple, user_dynamic(log, videos, day).collect()))
    all_days = user_dynamic(log, videos).where(F.col("dt") == F.lit(day))
    assert one == sorted(map(tuple, all_days.collect()))


def test_trailing_window_counts_calendar_days(spark):
    days = [1, 2, 7, 8, 20]
    daily = spark.createDataFrame([(1, date(2024, 1, d), 1) for d in days], "user_id long, dt date, n long")
    got = {r.dt.day: (r.n_7d, r.active_days_7d) for r in trailing(daily, "user_id", ["n"]).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 7: (3, 3), 8: (3, 3), 20: (1, 1)}


def test_trailing_distinct_counts_each_item_once(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice([1, 2, None]), rng.choice([None, *range(6)]), date(2024, 1, 1) + timedelta(days=rng.choice([0, 1, 2, 6, 7, 8, 13, 30])))
        for _ in range(300)
    ]
    log = spark.createDataFrame(rows, "user_id long, video_id long, dt date")
    for days in (1, 2, 7, 40):
        got = {(r.user_id, r.dt): r[2] for r in trailing_distinct(log, "user_id", "video_id", days).collect()}
        want = {
            (u, d): len({v for w, v, e in rows if w == u and v is not None and timedelta(0) <= d - e < timedelta(days=days)})
            for u, _, d in rows
        }
        assert got == want
    assert trailing_distinct(log.limit(0), "user_id", "video_id").count() == 0


def test_daily_activity(make_log, rows):
    total = daily_activity(make_log(rows)).agg(F.sum("clicks")).first()[0]
    assert total == sum(r[4] == "click" for r in rows)


def test_video_feature_ranks_by_price(spark):
    rows = [(date(2024, 1, 1), 1, "a", 3, 5.0, 2), (date(2024, 1, 1), 2, "b", 4, 9.0, 1), (date(2024, 1, 1), 3, "b", 4, None, 3)]
    df = spark.createDataFrame(rows, "dt date, video_id long, category string, size int, price double, rank int")
    got = {r.video_id: (r.price_rank, r.trend_rank) for r in video_feature(df).collect()}
    assert got == {2: (1, 1), 1: (2, 2), 3: (3, 3)}


def test_price_ranks_have_no_end(spark):
    df = spark.range(1500).selectExpr(
        "date'2024-01-01' as dt", "id as video_id", "'a' as category", "1 as size",
        "double(id) as price", "int(id) as rank",
    )
    assert [r.price_rank for r in video_feature(df).orderBy("price_rank").collect()] == list(range(1, 1501))
    assert top_n(df, ["category"], [F.desc("video_id")], 1200).count() == 1200


def test_top_n_limits_groups_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), "id")
    top = top_n(df, ["g"], [F.desc("id")], 4)
    assert top.groupBy("g").count().select("count").distinct().collect()[0][0] == 4
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("n", [0, 201, True])
def test_snapshot_size_is_bounded(spark, n):
    df = spark.createDataFrame([("KR", date(2024, 1, 1), 1)], "region string, dt date, video_id long")
    with pytest.raises(ValueError):
        trending_snapshot(df, "KR", [F.col("video_id")], n)


def test_snapshot_keeps_one_region(spark):
    rows = [(r, date(2024, 1, d), v) for r in ("KR", "US") for d in (1, 2) for v in range(9)]
    df = spark.createDataFrame(rows, "region string, dt date, video_id long")
    kept = trending_snapshot(df, "KR", [F.col("video_id")], 4).collect()
    assert len(kept) == 8 and {r.region for r in kept} == {"KR"}
    assert {r.video_id for r in kept} == {0, 1, 2, 3}


def test_latest_row_is_whole(spark):
    rows = [(1, 5, "a", None), (1, 7, "b", 2), (2, 1, "c", 3), (1, 7, "a", 9)]
    df = spark.createDataFrame(rows, "k long, t long, tie string, x long")
    got = {r.k: tuple(r) for r in latest_per_key(df, ["k"], "t", ["tie"]).collect()}
    assert got == {1: (1, 7, "b", 2), 2: (2, 1, "c", 3)}


def test_first_users(spark):
    df = spark.createDataFrame([(5,), (3,), (9,), (3,)], "user_id long")
    assert [r.user_id for r in first_n_users(df, 2).collect()] == [3, 5]
    assert first_n_users(df, 5000).count() == 3
    for n in (0, True):
        with pytest.raises(ValueError):
            first_n_users(df, n)
