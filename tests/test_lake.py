import glob
import hashlib
import shutil
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelake.catalog import ingest
from tidelake.operators.quality import ValidationError, validate_raw
from tidelake.plans.raw_load import RawTable, complete_days, load_day, load_days
from tidelake.session import scratch
from tidelake.sources import lake, schemas, sink

DAYS = ["2024-01-01", "2024-01-02", "2024-01-03"]


@pytest.fixture
def log(make_log):
    return make_log(
        [(10 * d + n, n, n, f"2024-01-0{d} 0{n}:00:00", "click") for d in (1, 2, 3) for n in range(4)]
    )


@pytest.fixture
def base(spark, log):
    path = scratch(spark, "lake")
    sink.backfill(log, path, schema=schemas.ACTION_LOG)
    return path


def counts(df):
    return {str(r.dt): r["count"] for r in df.groupBy("dt").count().collect()}


def digest(base, day):
    files = sorted(glob.glob(f"{base}/dt={day}/part-*"))
    return [(f, hashlib.md5(open(f, "rb").read()).hexdigest()) for f in files]


def test_day_column_comes_from_the_path_as_a_date(spark, base):
    df = lake.read_partition(spark, base, DAYS[0])
    assert dict(df.dtypes)["dt"] == "date"
    assert counts(df) == {DAYS[0]: 4}
    declared = lake.read_partition(spark, base, DAYS[0], schema=schemas.ACTION_LOG)
    assert declared.columns == [*schemas.ACTION_LOG.names, "dt"]


def test_left_over_copies_and_shards_are_not_read(spark, base):
    part = glob.glob(f"{base}/dt={DAYS[0]}/part-*.parquet")[0]
    shutil.copy(part, f"{base}/dt={DAYS[0]}/part-0.parquet.copy-of-last-run")
    shutil.copytree(f"{base}/dt={DAYS[1]}", f"{base}/dt={DAYS[1]}/shard=001")
    assert counts(lake.read_lake(spark, base)) == dict.fromkeys(DAYS, 4)
    assert counts(lake.read_partition(spark, base, DAYS[0])) == {DAYS[0]: 4}
    assert lake.source_view(spark, base, DAYS[1]).count() == 4
    assert spark.table("source_files").count() == 4


def test_window_read_names_absent_days(spark, base):
    wanted = lake.days_between(date(2024, 1, 2), date(2024, 1, 9))
    assert counts(lake.read_days(spark, base, wanted, missing_ok=True)) == {DAYS[1]: 4, DAYS[2]: 4}
    with pytest.raises(FileNotFoundError, match="2024-01-09"):
        lake.read_days(spark, base, wanted)
    with pytest.raises(FileNotFoundError):
        lake.read_days(spark, base, [date(2025, 1, 1)])


def test_partition_without_marker_is_not_ready(spark, base, log):
    with pytest.raises(lake.PartitionNotReadyError):
        lake.read_partition(spark, base, DAYS[0], require_success=True)
    sink.replace_partition(log.where("dt = '2024-01-01'"), base, DAYS[0], overwrite=True)
    assert lake.read_partition(spark, base, DAYS[0], require_success=True).count() == 4


def test_a_committed_scan_follows_the_manifest(spark, base):
    folder = f"{base}/dt={DAYS[0]}".removeprefix("file:")
    found = lake.day_manifest(spark, base, DAYS[0])
    assert found["rows"] == 4 and set(found["files"]) <= {p.split("/")[-1] for p in glob.glob(f"{folder}/part-*")}
    part = sorted(found["files"])[0]
    shutil.copy(f"{folder}/{part}", f"{folder}/part-77777-not-named.parquet")
    assert lake.read_partition(spark, base, DAYS[0]).count() == 8
    assert lake.read_partition(spark, base, DAYS[0], committed=True).count() == 4
    assert lake.read_days(spark, base, DAYS, committed=True).count() == 12
    assert lake.commit_day(spark, base, DAYS[0], "again") == lake.day_manifest(spark, base, DAYS[0])
    assert lake.read_partition(spark, base, DAYS[0], committed=True).count() == 8


def test_a_half_arrived_day_is_not_ready(spark, base, log):
    target, ledger = scratch(spark, "raw"), scratch(spark, "ledger")
    folder = f"{base}/dt={DAYS[1]}".removeprefix("file:")
    part = glob.glob(f"{folder}/part-*.parquet")[0]
    shutil.move(part, f"{folder}/aside")
    days = [date.fromisoformat(d) for d in DAYS]
    with pytest.raises(lake.PartitionNotReadyError, match="lacks part-"):
        load_days(spark, base, target, days, TABLE, ledger)
    with open(part, "w") as short:
        short.write("PAR1")
    with pytest.raises(lake.PartitionNotReadyError):
        load_day(spark, base, target, days[1], TABLE, ledger)
    shutil.move(f"{folder}/aside", part)
    shutil.move(f"{folder}/{lake.MANIFEST}", f"{folder}/_aside")
    with pytest.raises(lake.PartitionNotReadyError, match="no commit manifest"):
        lake.read_days(spark, base, days, committed=True)
    assert complete_days(spark, base, days)[0] == [days[0], days[2]]
    load_day(spark, base, target, days[1], TABLE, ledger, committed=False)
    assert lake.partitions(spark, target) == [DAYS[1]]


def test_a_repeated_load_leaves_one_ledger_entry(spark, base, log):
    target, ledger = scratch(spark, "raw"), scratch(spark, "ledger")
    days = [date.fromisoformat(d) for d in DAYS]
    for _ in range(2):
        load_days(spark, base, target, days, TABLE, ledger)
        load_day(spark, base, target, days[0], TABLE, ledger, committed=True)
    assert spark.read.parquet(ledger).count() == 3
    sink.backfill(log.where("dt = '2024-01-03' and event_id = 30"), base)
    load_days(spark, base, target, days, TABLE, ledger)
    assert counts(spark.read.parquet(ledger)) == {DAYS[0]: 1, DAYS[1]: 1, DAYS[2]: 2}
    assert lake.day_manifest(spark, target, DAYS[2])["load_id"] == lake.day_manifest(spark, base, DAYS[2])["load_id"]


def test_content_check_sees_swapped_and_moved_values(spark, log):
    def said(loaded, source):
        return {r.content_check for r in validate_raw(loaded, source, TABLE.required, TABLE.key, content=True).collect()}

    assert said(log.orderBy(F.rand(1)).repartition(3), log) == {"ok"}
    other = {"user_id": "video_id", "video_id": "user_id"}
    moved = log.withColumn("user_id", F.col("user_id") + 1)
    assert said(moved.select(*[F.col(other.get(c, c)).alias(c) for c in log.columns]), moved) != {"ok"}
    gap, shifted = (log.withColumn(c, F.lit(None).cast("long")).withColumn(d, F.lit(5).cast("long"))
                    for c, d in (("user_id", "video_id"), ("video_id", "user_id")))
    assert said(gap, shifted) != {"ok"} and said(gap, gap) == {"ok"}


def test_missing_partitions(spark, base):
    inventory = lake.read_lake(spark, base).where("dt <> '2024-01-02'")
    got = lake.missing_partitions(inventory, date(2024, 1, 1), date(2024, 1, 4)).collect()
    assert sorted(str(r.dt) for r in got) == ["2024-01-02", "2024-01-04"]
    assert lake.partitions(spark, base) == DAYS


def test_replace_twice_equals_once_and_leaves_other_days_alone(spark, base, log):
    before = digest(base, DAYS[0]), digest(base, DAYS[2])
    one = log.where("dt = '2024-01-02' and event_id < 22")
    for _ in range(2):
        assert sink.replace_partition(one, base, DAYS[1], overwrite=True) == 2
        assert counts(lake.read_lake(spark, base)) == {DAYS[0]: 4, DAYS[1]: 2, DAYS[2]: 4}
    assert (digest(base, DAYS[0]), digest(base, DAYS[2])) == before


def test_rebalancing_evens_out_the_files(spark, base, log):
    scattered = log.where("dt = '2024-01-02'").repartition(4)
    assert sink.replace_partition(scattered, base, DAYS[1], overwrite=True, rebalance=True) == 4
    assert len(digest(base, DAYS[1])) == 1
    assert sink.replace_partition(scattered, base, DAYS[1], overwrite=True) == 4
    assert len(digest(base, DAYS[1])) > 1


def test_existing_day_needs_permission(base, log):
    with pytest.raises(sink.PartitionExistsError):
        sink.replace_partition(log.where("dt = '2024-01-02'"), base, DAYS[1])


def test_empty_day_is_refused_and_the_old_one_stays(spark, base, log):
    with pytest.raises(sink.EmptyPartitionError):
        sink.replace_partition(log.where("false"), base, DAYS[1], overwrite=True)
    assert counts(lake.read_lake(spark, base)) == dict.fromkeys(DAYS, 4)


def test_rows_of_another_day_are_refused(spark, base, log):
    with pytest.raises(sink.ForeignRowsError):
        sink.replace_partition(log, base, DAYS[1], overwrite=True)
    assert counts(lake.read_lake(spark, base)) == dict.fromkeys(DAYS, 4)


def test_backfill_keeps_days_absent_from_the_source(spark, base, log):
    sink.backfill(log.where("dt = '2024-01-03' and event_id = 30"), base)
    assert counts(lake.read_lake(spark, base)) == {DAYS[0]: 4, DAYS[1]: 4, DAYS[2]: 1}


def test_backfill_refuses_rows_without_a_day(base, log):
    with pytest.raises(PySparkException, match="partition day"):
        sink.backfill(log.withColumn("dt", F.lit(None).cast("date")), base)


def test_schema_drift_is_refused(spark, log):
    for drifted in (
        log.drop("value"),
        log.withColumn("extra", F.lit(1)),
        log.withColumn("value", F.lit(1)),
    ):
        with pytest.raises(schemas.SchemaDriftError):
            schemas.assert_schema(drifted, schemas.ACTION_LOG)


def test_null_in_a_required_column_stops_the_write(spark, log):
    spine = log.select("event_id", "user_id", "video_id", "event_timestamp", "dt")
    broken = spine.withColumn("label", F.when(F.col("user_id") > 0, 1))
    checked = schemas.assert_schema(broken, schemas.TRAINING_ENTITY)
    with pytest.raises(PySparkException, match="required label"):
        checked.write.parquet(scratch(spark, "required"))


def test_layers_must_not_overlap():
    sink.assert_layers_apart("gs://b/raw", "gs://b/features")
    for raw, feature in (("gs://b/x", "gs://b/x/"), ("gs://b/x", "gs://b/x/y"), ("b/x/y", "b/x")):
        with pytest.raises(sink.LayerError):
            sink.assert_layers_apart(raw, feature)


def test_quarantine_split_names_every_broken_rule(spark, log):
    rules = {"odd": F.col("event_id") % 2 == 1, "late": F.col("event_id") > 30, "null": F.col("value").isNull()}
    good, bad = sink.split_quarantine(log, rules)
    reasons = {r.event_id: r.reasons for r in bad.collect()}
    assert reasons[31] == ["odd", "late"] and reasons[11] == ["odd"]
    assert good.count() + len(reasons) == log.count()
    assert sink.split_quarantine(log, {"unknown": F.col("event_id") > F.lit(None)})[0].count() == 0
    path = scratch(spark, "aside")
    sink.write_quarantine(bad, path)
    assert spark.read.json(path).count() == len(reasons)


TABLE = RawTable("log", schemas.ACTION_LOG, ("event_id", "user_id"), "event_id")


def test_load_records_a_day_only_after_its_checks(spark, base):
    target, ledger = scratch(spark, "raw"), scratch(spark, "ledger")
    load_day(spark, base, target, date(2024, 1, 1), TABLE, ledger)
    load_days(spark, base, target, [date(2024, 1, 2), date(2024, 1, 3)], TABLE, ledger)
    assert counts(lake.read_lake(spark, target)) == dict.fromkeys(DAYS, 4)
    entries = spark.read.parquet(ledger).collect()
    assert sorted(str(r.dt) for r in entries) == DAYS


def test_bad_day_raises_and_is_not_recorded(spark, log):
    source, target, ledger = (scratch(spark, n) for n in ("src", "raw", "ledger"))
    sink.backfill(log.unionByName(log.where("event_id = 10")), source)
    with pytest.raises(ValidationError, match="1 duplicate event_id rows"):
        load_day(spark, source, target, date(2024, 1, 1), TABLE, ledger)
    with pytest.raises(PySparkException):
        spark.read.parquet(ledger)


def test_a_failed_reload_leaves_the_good_day(spark, base, log):
    target, ledger, worse = (scratch(spark, n) for n in ("raw", "ledger", "src"))
    load_day(spark, base, target, date(2024, 1, 1), TABLE, ledger)
    before = sorted(map(tuple, lake.read_partition(spark, target, DAYS[0]).collect()))
    sink.backfill(log.unionByName(log.where("event_id = 10")), worse)
    with pytest.raises(ValidationError):
        load_day(spark, worse, target, date(2024, 1, 1), TABLE, ledger)
    assert sorted(map(tuple, lake.read_partition(spark, target, DAYS[0]).collect())) == before
    with pytest.raises(FileNotFoundError):
        load_days(spark, base, target, [date(2024, 1, 1), date(2024, 2, 1)], TABLE, ledger)
    assert spark.read.parquet(ledger).count() == 1


def test_a_clean_rerun_empties_the_days_quarantine(spark, log):
    path = scratch(spark, "aside")
    bad = sink.split_quarantine(log, {"odd": F.col("event_id") % 2 == 1})[1]
    sink.write_quarantine(bad, path)
    rows = spark.read.json(path)
    day = date.fromisoformat(DAYS[0])
    others = rows.where(F.col("dt") != F.lit(day)).count()
    assert 0 < others < rows.count()
    sink.write_quarantine(bad.limit(0), path, day)
    assert spark.read.json(path).count() == others


def test_check_sums_equal_plain_ones_and_wrap_beyond_64_bits(spark):
    days = {"2024-01-01": [5, -7], "2024-01-02": [2**63 - 1, 2], "2024-01-03": [-(2**63), -1], "2024-01-04": [None],
            "2024-01-05": [2**63 - 1, 2**63 - 1, -(2**63), 1]}
    df = spark.createDataFrame([(d, n) for d, numbers in days.items() for n in numbers], "dt string, n long")
    found = dict(map(tuple, df.groupBy("dt").agg(ingest._check_sum(F.col("n"))).collect()))
    signed = lambda n: (n + 2**63) % 2**64 - 2**63
    assert found == {d: None if n == [None] else signed(sum(n)) for d, n in days.items()}


def test_a_day_of_many_rows_has_a_checksum(spark, make_log):
    log = make_log([(1, 2, 3, "2024-01-01 01:00:00", "click")]).withColumn("event_id", F.lit(2**62))
    few, many = (ingest._per_day(log.join(spark.range(n), how="cross")).first() for n in (1, 200_000))
    assert (few.rows, many.rows) == (1, 200_000)
    assert few.id_sum == 2**62 and many.id_sum == 0  # 200,000 is divisible by four
    assert 0 <= few.content < 2**48
    assert many.content == (few.content * 200_000 + 2**63) % 2**64 - 2**63
