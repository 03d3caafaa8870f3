from datetime import datetime, timedelta

import pytest

from tidelake.session import cut, scratch, shared_dir
from tidelake.sources.fs import SharedFs
from tidelake.sources.online import (
    SnapshotLayoutError,
    manifest,
    materialize,
    merge,
    read_online,
    vacuum,
    versions,
    watermark,
)

T = [datetime(2024, 1, 1) + timedelta(days=n) for n in range(8)]
SCHEMA = "user_id long, event_timestamp timestamp_ntz, x long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_incremental_runs_keep_the_newest_row(spark):
    base = scratch(spark, "online")
    features = spark.createDataFrame(
        [(1, T[0], 10), (1, T[2], 12), (2, T[1], 21), (1, T[5], 15), (3, T[5], 35)], SCHEMA
    )
    with pytest.raises(FileNotFoundError):
        read_online(spark, base, "v")
    assert rows(materialize(features, base, "v", ["user_id"], T[3])) == [(1, T[2], 12), (2, T[1], 21)]
    assert watermark(spark, base, "v") == T[3]
    assert rows(materialize(features, base, "v", ["user_id"], T[6])) == [
        (1, T[5], 15), (2, T[1], 21), (3, T[5], 35),
    ]


def test_span_is_open_at_its_start_and_closed_at_its_end(spark):
    base = scratch(spark, "online")
    materialize(spark.createDataFrame([(1, T[3], 1)], SCHEMA), base, "v", ["user_id"], T[3])
    late = spark.createDataFrame([(2, T[3], 2), (3, T[4], 3)], SCHEMA)
    assert rows(materialize(late, base, "v", ["user_id"], T[4])) == [(1, T[3], 1), (3, T[4], 3)]


def test_repeating_a_run_changes_nothing(spark):
    base = scratch(spark, "online")
    features = spark.createDataFrame([(1, T[0], 1)], SCHEMA)
    first = rows(materialize(features, base, "v", ["user_id"], T[1]))
    assert rows(materialize(features, base, "v", ["user_id"], T[1])) == first
    assert versions(spark, base, "v") == [1]


def test_run_lost_before_its_state_file_is_done_again(spark):
    base = scratch(spark, "online")
    features = spark.createDataFrame([(1, T[0], 1), (1, T[2], 2)], SCHEMA)
    materialize(features, base, "v", ["user_id"], T[1])
    spark.createDataFrame([(9, T[0], 9)], SCHEMA).write.parquet(f"{base}/v/data/v=2/bucket=0")
    assert rows(read_online(spark, base, "v")) == [(1, T[0], 1)]
    assert rows(materialize(features, base, "v", ["user_id"], T[3])) == [(1, T[2], 2)]


def test_half_written_state_file_is_not_read(spark):
    base = scratch(spark, "online")
    features = spark.createDataFrame([(1, T[0], 1)], SCHEMA)
    materialize(features, base, "v", ["user_id"], T[1])
    with open(f"{base.removeprefix('file:')}/v/manifest/0000000002.json.part", "w") as lost:
        lost.write('{"vers')
    assert watermark(spark, base, "v") == T[1]
    materialize(features, base, "v", ["user_id"], T[2])
    assert watermark(spark, base, "v") == T[2]
    with pytest.raises(FileExistsError):
        SharedFs(spark, base).create_text(f"{base}/v/manifest/0000000002.json", "x")


def files(spark, base):
    """Data file -> modification time."""
    found = {}
    for row in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(
        f"{base}/v/data"
    ).select("path", "modificationTime").collect():
        found[row.path] = row.modificationTime
    return found


def test_an_increment_rewrites_only_buckets_with_fresh_rows(spark):
    base = scratch(spark, "online")
    first = spark.createDataFrame([(i, T[0], i) for i in range(400)], SCHEMA)
    materialize(first, base, "v", ["user_id"], T[1], buckets=16)
    before, old = files(spark, base), read_online(spark, base, "v")
    assert len(before) == 16
    second = spark.createDataFrame([(3, T[2], -3), (3, T[1], 0), (5000, T[2], 1)], SCHEMA)
    after_rows = rows(materialize(second, base, "v", ["user_id"], T[3], buckets=99))
    after = files(spark, base)
    assert after_rows == sorted([(i, T[0], i) for i in range(400) if i != 3] + [(3, T[2], -3), (5000, T[2], 1)])
    assert {p: after[p] for p in before} == before  # nothing is deleted or written again
    assert 1 <= len(after) - len(before) <= 2
    one, two = manifest(spark, base, "v", 1), manifest(spark, base, "v")
    stay = [b for b in one["buckets"] if two["buckets"][b] == 1]
    assert len(stay) >= 14 and two["bucket_count"] == 16
    assert rows(old) == [(i, T[0], i) for i in range(400)]  # a reader of the version before
    assert rows(read_online(spark, base, "v", 1)) == rows(old)


def test_an_increment_reads_only_the_buckets_it_rewrites(spark):
    base = scratch(spark, "online")
    materialize(spark.createDataFrame([(i, T[0], i) for i in range(200)], SCHEMA), base, "v", ["user_id"], T[1], buckets=8)
    touched = {r.b for r in spark.createDataFrame([(3,)], "user_id long").selectExpr("pmod(xxhash64(user_id), 8) b").collect()}
    for bucket in range(8):
        if bucket not in touched:  # a read of any other bucket would fail
            for name in SharedFs(spark, base).names(f"{base}/v/data/v=1/bucket={bucket}"):
                SharedFs(spark, base).delete(f"{base}/v/data/v=1/bucket={bucket}/{name}")
    merge(spark.createDataFrame([(3, T[2], 9)], SCHEMA), base, "v", 1, ["user_id"], "event_timestamp", T[2])
    assert manifest(spark, base, "v")["buckets"][str(min(touched))] == 2


def test_an_empty_increment_moves_the_watermark_alone(spark):
    base = scratch(spark, "online")
    nothing = spark.createDataFrame([], SCHEMA)
    assert rows(materialize(nothing, base, "v", ["user_id"], T[0])) == []
    materialize(spark.createDataFrame([(1, T[1], 1)], SCHEMA), base, "v", ["user_id"], T[1])
    assert rows(materialize(nothing, base, "v", ["user_id"], T[2])) == [(1, T[1], 1)]
    assert watermark(spark, base, "v") == T[2] and versions(spark, base, "v") == [1, 2, 3]


def test_rows_of_another_shape_are_refused(spark):
    base = scratch(spark, "online")
    materialize(spark.createDataFrame([(1, T[0], 1)], SCHEMA), base, "v", ["user_id"], T[1])
    other = spark.createDataFrame([(1, T[2], "x")], "user_id long, event_timestamp timestamp_ntz, x string")
    with pytest.raises(SnapshotLayoutError):
        materialize(other, base, "v", ["user_id"], T[3])
    with pytest.raises(SnapshotLayoutError):
        materialize(spark.createDataFrame([(1, T[2], 1)], SCHEMA), base, "v", ["x"], T[3])


def test_vacuum_keeps_what_remaining_versions_refer_to(spark):
    base = scratch(spark, "online")
    for n in range(6):
        fresh = spark.createDataFrame([(i, T[n], n) for i in (range(100) if n == 0 else [n])], SCHEMA)
        materialize(fresh, base, "v", ["user_id"], T[n], buckets=8)
    want = [rows(read_online(spark, base, "v", v)) for v in (5, 6)]
    assert vacuum(spark, base, "v", keep=2) == []  # all of them are too young
    gone = vacuum(spark, base, "v", keep=2, older_than=timedelta(0))
    assert gone and versions(spark, base, "v") == [5, 6]
    assert [rows(read_online(spark, base, "v", v)) for v in (5, 6)] == want
    assert vacuum(spark, base, "v", keep=2, older_than=timedelta(0)) == []
    with pytest.raises(Exception):
        read_online(spark, base, "v", 1).collect()
    assert len(files(spark, base)) < 8 + 5


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(named.rstrip("/"))
    assert scratch(spark, "x") != scratch(spark, "x")


def test_cut_survives_in_the_shared_folder(spark):
    df = cut(spark.range(10))
    assert df.count() == 10
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
