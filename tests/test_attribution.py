import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.operators.attribution import (
    NoPositivesError,
    attribute_clicks,
    label_rate,
    last_touch,
    require_positives,
)


def brute_force(rows, keys, seconds):
    """Ids of the impressions that are the latest one before some click in time."""
    where = {"user_id": 1, "video_id": 2}
    key = lambda r: tuple(r[where[k]] for k in keys)
    shown = [r for r in rows if r[4] == "impression"]
    hits = set()
    for c in (r for r in rows if r[4] == "click"):
        if None in key(c):
            continue
        at = datetime.fromisoformat(c[3])
        earlier = [i for i in shown if key(i) == key(c) and datetime.fromisoformat(i[3]) <= at]
        if earlier:
            last = max(earlier, key=lambda i: (i[3], i[0]))
            if at - datetime.fromisoformat(last[3]) <= timedelta(seconds=seconds):
                hits.add(last[0])
    return {i[0]: int(i[0] in hits) for i in shown}


def labels(df):
    return {r.event_id: r.label for r in df.collect()}


def random_rows(seed, n=400, users=3, videos=2, minutes=3 * 24 * 60, step=1):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = start + timedelta(minutes=step * rng.randrange(minutes // step))
        user = None if rng.random() < 0.03 else rng.randrange(users)
        kind = rng.choice(["impression", "impression", "click", "view"])
        rows.append((i, user, rng.randrange(videos), str(at), kind))
    return rows


@pytest.mark.parametrize(
    ("seed", "keys", "seconds", "step"),
    [
        (1, ("user_id", "video_id"), 1800, 1),
        (2, ("user_id",), 1800, 15),
        (3, ("user_id",), 6 * 3600, 30),
        (4, ("user_id", "video_id"), 24 * 3600, 60),
        (5, ("user_id",), 60, 1),
    ],
)
def test_agrees_with_brute_force(make_log, seed, keys, seconds, step):
    rows = random_rows(seed, step=step)
    for bucket in (None, 60, 300, 7200):
        got = labels(attribute_clicks(make_log(rows), keys, seconds, bucket_seconds=bucket))
        assert got == brute_force(rows, keys, seconds)


def test_many_small_groups_full_of_ties(make_log):
    rows = random_rows(21, n=1500, users=60, videos=2, minutes=90, step=5)
    for seconds, bucket in ((300, 300), (600, 60), (1800, 900)):
        got = labels(attribute_clicks(make_log(rows), ["user_id"], seconds, bucket_seconds=bucket))
        assert got == brute_force(rows, ("user_id",), seconds)


@pytest.mark.parametrize(("seconds", "bucket"), [(600, 60), (3600, 900)])
def test_last_touch_names_the_impressions_that_get_a_label(make_log, seconds, bucket):
    rows = random_rows(22, n=900, users=20, minutes=300, step=5)
    log = make_log(rows)
    touched = last_touch(log, ["user_id"], seconds, bucket).collect()
    assert len(touched) == sum(r[4] == "click" for r in rows)
    labelled = {k for k, v in brute_force(rows, ("user_id",), seconds).items() if v}
    assert {r.impression_id for r in touched} - {None} == labelled


def test_days_add_up_to_the_whole(make_log):
    rows = random_rows(7)
    log = make_log(rows)
    whole = labels(attribute_clicks(log, ["user_id"], 6 * 3600))
    slices = {}
    for n in range(5):
        day = date(2024, 1, 1) + timedelta(days=n)
        part = labels(attribute_clicks(log, ["user_id"], 6 * 3600, day))
        assert not part.keys() & slices.keys()
        slices.update(part)
    assert slices == whole and sum(whole.values()) > 10


def test_click_after_local_midnight_labels_the_day_before(make_log):
    log = make_log(
        [(1, 1, 1, "2024-01-01 14:50:00", "impression"), (2, 1, 1, "2024-01-01 15:10:00", "click")]
    )
    assert labels(attribute_clicks(log, day=date(2024, 1, 1))) == {1: 1}
    assert labels(attribute_clicks(log, day=date(2024, 1, 2))) == {}


@pytest.mark.parametrize(("at", "label"), [("00:30:00", 1), ("00:30:01", 0), ("00:00:00", 1)])
def test_both_bounds_are_inclusive(make_log, at, label):
    log = make_log(
        [(1, 1, 1, "2024-01-01 00:00:00", "impression"), (2, 1, 1, f"2024-01-01 {at}", "click")]
    )
    assert labels(attribute_clicks(log)) == {1: label}


def test_ties_go_to_the_larger_id_and_one_click_labels_one_row(make_log):
    log = make_log(
        [
            (1, 1, 1, "2024-01-01 00:00:00", "impression"),
            (2, 1, 1, "2024-01-01 00:00:00", "impression"),
            (3, 1, 1, "2024-01-01 00:00:00", "click"),
            (4, 1, 1, "2024-01-01 00:00:05", "click"),
        ]
    )
    assert labels(attribute_clicks(log)) == {1: 0, 2: 1}


def test_hot_key_is_spread_over_its_buckets(spark, make_log):
    """No window group grows with the share of one key, only with its rate per bucket."""
    start = datetime(2024, 1, 1)
    rows = [(i, 7, 7, str(start + timedelta(seconds=30 * i)), "impression") for i in range(2000)]
    plan = attribute_clicks(make_log(rows), ["user_id"], 6 * 3600)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in text and "CartesianProduct" not in text and "Join" not in text
    assert plan.count() == 2000


@pytest.mark.parametrize("seconds", [10, 86_400])
def test_bucket_length_never_changes_labels(make_log, seconds):
    log = make_log(random_rows(21))
    assert labels(attribute_clicks(log, bucket_seconds=seconds)) == labels(attribute_clicks(log))


def test_wide_windows_need_the_whole_log(make_log):
    log = make_log([(1, 1, 1, "2024-01-01 00:00:00", "impression"), (2, 1, 1, "2024-01-03 00:00:00", "click")])
    assert labels(attribute_clicks(log, window_seconds=3 * 86_400)) == {1: 1}
    with pytest.raises(ValueError):
        attribute_clicks(log, window_seconds=86_401, day=date(2024, 1, 1))


def test_label_rate_and_guard(make_log):
    log = make_log(
        [(1, 1, 1, "2024-01-01 00:00:00", "impression"), (2, 2, 1, "2024-01-01 00:00:00", "impression")]
    )
    spine = attribute_clicks(log)
    row = label_rate(spine).first()
    assert (row["rows"], row.positives, row.label_rate) == (2, 0, 0.0)
    with pytest.raises(NoPositivesError):
        require_positives(spine)
    assert require_positives(spine.withColumn("label", F.lit(1))).count() == 2
