"""Online snapshot: the latest feature row of every entity, in key-hash buckets.

``<base>/<view>/data/v=N/bucket=B`` holds the rows of one bucket as version N wrote them, and
``<base>/<view>/manifest/N.json`` names for every bucket the version whose files are in
force, with the watermark. An increment rewrites the buckets that have fresh rows; all
others stay the files they are. The manifest is written last and never replaced, so a lost
run leaves the version before in force and a repeated run covers the same span again.

No file is deleted by a write. A reader that holds an older version keeps its files until
``vacuum`` is told that nobody reads so old a version any more.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.ranking import latest_per_key
from tidelake.session import scratch
from tidelake.sources.fs import SharedFs

BUCKETS = 64


class SnapshotLayoutError(ValueError):
    """Rows or keys that do not fit the snapshot they were to be merged into."""


def versions(spark: SparkSession, base: str, view: str) -> list[int]:
    """Published versions whose manifests are kept, oldest first."""
    names = SharedFs(spark, base).names(f"{base}/{view}/manifest")
    return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]


def manifest(spark: SparkSession, base: str, view: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default the newest; None before the first."""
    if version is None:
        known = versions(spark, base, view)
        if not known:
            return None
        version = known[-1]
    return json.loads(SharedFs(spark, base).read_text(f"{base}/{view}/manifest/{version:010d}.json"))


def watermark(spark: SparkSession, base: str, view: str) -> datetime | None:
    """End of the span the view has taken in so far."""
    found = manifest(spark, base, view)
    return datetime.fromisoformat(found["watermark"]) if found else None


def _rows(spark: SparkSession, root: str, found: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a manifest, or those of some of its buckets alone."""
    schema = T.StructType.fromJson(found["schema"])
    paths = [
        f"{root}/data/v={version}/bucket={bucket}"
        for bucket, version in found["buckets"].items()
        if buckets is None or int(bucket) in buckets
    ]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_online(spark: SparkSession, base: str, view: str, version: int | None = None) -> DataFrame:
    found = manifest(spark, base, view, version)
    if found is None:
        raise FileNotFoundError(f"{view} has not been materialized")
    return _rows(spark, f"{base}/{view}", found)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The newer row of each key; each side pre-aggregates before the shuffle."""
    rows = new if old is None else old.unionByName(new)
    return latest_per_key(rows, keys, ts)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def materialize(
    features: DataFrame,
    base: str,
    view: str,
    keys: list[str],
    now: datetime,
    ts: str = "event_timestamp",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Take in feature rows of ``(watermark, now]`` and publish a new version."""
    spark = features.sparkSession
    mark = watermark(spark, base, view)
    if mark is not None and now <= mark:
        return read_online(spark, base, view)
    kind = features.schema[ts].dataType
    fresh = features.where(F.col(ts) <= F.lit(now.isoformat()).cast(kind))
    if mark is not None:
        fresh = fresh.where(F.col(ts) > F.lit(mark.isoformat()).cast(kind))
    known = versions(spark, base, view)
    merge(fresh, base, view, known[-1] if known else 0, keys, ts, now, buckets)
    return read_online(spark, base, view)


def _check(found: dict, fresh: DataFrame, keys: list[str]) -> None:
    have = {f["name"]: f["type"] for f in found["schema"]["fields"]}
    come = {f["name"]: f["type"] for f in fresh.schema.jsonValue()["fields"]}
    if have != come or found["keys"] != keys:
        raise SnapshotLayoutError(f"snapshot of {have} by {found['keys']}, rows of {come} by {keys}")


def merge(
    fresh: DataFrame,
    base: str,
    view: str,
    version: int,
    keys: list[str],
    ts: str,
    mark: datetime,
    buckets: int = BUCKETS,
) -> None:
    """Publish version + 1: a published version with newer rows put over it; version 0 is empty.

    The number of buckets is fixed by the first version. A version that is published
    already stays as it is, so a repeated run changes nothing.
    """
    spark = fresh.sparkSession
    fs, root = SharedFs(spark, base), f"{base}/{view}"
    target = f"{root}/manifest/{version + 1:010d}.json"
    if fs.exists(target):
        return
    before = manifest(spark, base, view, version) if version else None
    if before:
        _check(before, fresh, keys)
        buckets = before["bucket_count"]
        fresh = fresh.select(*[f["name"] for f in before["schema"]["fields"]])
    own = bucket_of(keys, buckets)
    aside = scratch(spark, f"fresh-{view}")
    latest_per_key(fresh, keys, ts).withColumn("_bucket", own).write.parquet(aside)
    newest = spark.read.parquet(aside)
    touched = sorted(r["_bucket"] for r in newest.select("_bucket").distinct().collect())
    old = _rows(spark, root, before, touched) if before else None
    merged = upsert(old, newest.drop("_bucket"), keys, ts)
    folder = f"{root}/data/v={version + 1}"
    if touched:
        (
            merged.withColumn("bucket", own)
            .hint("rebalance", "bucket")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(folder)
        )
    state = {
        "version": version + 1,
        "watermark": mark.isoformat(),
        "published": datetime.now().isoformat(),
        "keys": keys,
        "bucket_count": buckets,
        "schema": before["schema"] if before else fresh.schema.jsonValue(),
        "buckets": {**(before["buckets"] if before else {}), **{str(b): version + 1 for b in touched}},
    }
    fs.create_text(target, json.dumps(state))
    SharedFs(spark, aside).delete(aside)


def vacuum(
    spark: SparkSession, base: str, view: str, keep: int = 3, older_than: timedelta = timedelta(days=1)
) -> list[str]:
    """Forget versions behind the newest ``keep`` that were published before ``older_than`` ago.

    Deletes their manifests, and the buckets that no remaining version refers to; returns the
    deleted bucket folders. Manifests go first: a run that is lost in between leaves files
    that nobody reads, which the next run finds.
    """
    fs, root = SharedFs(spark, base), f"{base}/{view}"
    known = versions(spark, base, view)
    limit = datetime.now() - older_than
    kept = []
    for version in known:
        found = manifest(spark, base, view, version)
        if version in known[-keep:] or datetime.fromisoformat(found["published"]) > limit:
            kept.append(found)
        else:
            fs.delete(f"{root}/manifest/{version:010d}.json")
    used = {(v, b) for found in kept for b, v in found["buckets"].items()}
    gone = []
    for name in fs.names(f"{root}/data"):
        version = int(name.removeprefix("v="))
        if not kept or version >= kept[0]["version"]:
            continue  # a version that may still be written, or is kept itself
        for folder in fs.names(f"{root}/data/{name}"):
            if folder.startswith("bucket=") and (version, folder.removeprefix("bucket=")) not in used:
                fs.delete(f"{root}/data/{name}/{folder}")
                gone.append(f"{name}/{folder}")
        if not any(n.startswith("bucket=") for n in fs.names(f"{root}/data/{name}")):
            fs.delete(f"{root}/data/{name}")
    return gone
