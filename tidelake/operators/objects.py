"""Object-store inventory audit over a table of object URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The URI scheme, and the forms of a partition folder and its files.
SCHEME = "gs://"
DAY_FOLDER = r"dt=(\d{4}-\d{2}-\d{2})"
FILE = r"part-[^/]*\.parquet"
STAGED = rf"{FILE}\.staging-[^/]+"
SHARDED = rf"shard=[^/]+/{FILE}"


def _after_scheme(uri: Column) -> Column:
    return F.substring(uri, len(SCHEME) + 1, 1 << 30)


def _strip_slashes(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("^/+|/+$"), F.lit(""))


def _bucket(rest: Column) -> Column:
    return F.substring_index(rest, "/", 1)


def _path(rest: Column) -> Column:
    return F.regexp_extract(rest, r"(?s)^[^/]*/(.*)$", 1)


def has_odd_segment(path: Column) -> Column:
    """True when a path has an empty, ``.`` or ``..`` segment."""
    return F.regexp_like(path, F.lit(r"(?:^|/)\.{0,2}(?:/|\z)"))


def split_base_path(uri: Column) -> Column:
    """``struct(bucket, prefix)`` of a base path, NULL when it has no such form.

    Outer slashes are ignored, inner ones are left as they are.
    """
    rest = _strip_slashes(_after_scheme(uri))
    valid = F.startswith(uri, F.lit(SCHEME)) & (_bucket(rest) != "") & (_path(rest) != "")
    return F.when(valid, F.struct(_bucket(rest).alias("bucket"), _path(rest).alias("prefix")))


def partition_object(uri: Column, day: Column, file: str = "part-0.parquet") -> Column:
    """Path of a day's file inside the bucket of a base path, NULL for a bad base."""
    return F.concat(
        split_base_path(uri)["prefix"], F.lit("/dt="), day.cast("string"), F.lit(f"/{file}")
    )


def is_strict_path(uri: Column) -> Column:
    """Normalized ``scheme://bucket/path``: no back slash, no odd segment, no slash at the end."""
    rest = _after_scheme(uri)
    return F.coalesce(
        F.startswith(uri, F.lit(SCHEME))
        & ~F.contains(uri, F.lit("\\"))
        & (_bucket(rest) != "")
        & (_path(rest) != "")
        & ~has_odd_segment(_path(rest)),
        F.lit(False),
    )


def audit_objects(df: DataFrame, uri_col: str = "uri", strict: bool = False) -> DataFrame:
    """Add bucket, prefix, dt, file and class to every object URI.

    Classes: ``canonical``, ``staging``, ``shard``, ``other``, ``not_normalized`` and
    ``foreign``. Strict mode also refuses outer slashes and back slashes.
    """
    uri = F.col(uri_col)
    rest = _after_scheme(uri) if strict else _strip_slashes(_after_scheme(uri))
    audited = df.withColumns({"_bucket": _bucket(rest), "_path": _path(rest)})
    path = F.col("_path")
    ours = F.coalesce(F.startswith(uri, F.lit(SCHEME)), F.lit(False))
    normal = (F.col("_bucket") != "") & (path != "") & ~has_odd_segment(path)
    if strict:
        normal = normal & ~F.contains(uri, F.lit("\\"))
    day = F.regexp_extract(path, rf"(?:^|/){DAY_FOLDER}/", 1).try_cast("date")
    before = F.regexp_extract(path, rf"^(?:(.*?)/)?{DAY_FOLDER}/", 1)
    inside = F.regexp_extract(path, rf"(?:^|/){DAY_FOLDER}/(.*)$", 2)
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)

    def inside_is(form: str) -> Column:
        return F.col("dt").isNotNull() & F.regexp_like(inside, F.lit(f"^(?:{form})$"))

    usable = ours & normal
    return (
        audited.withColumn("dt", F.when(usable, day))
        .withColumn("bucket", F.when(usable, F.col("_bucket")))
        .withColumn(
            "prefix", F.when(usable, F.when(F.col("dt").isNotNull(), before).otherwise(folder))
        )
        .withColumn("file", F.when(usable, F.substring_index(path, "/", -1)))
        .withColumn(
            "class",
            F.when(~ours, "foreign")
            .when(~normal, "not_normalized")
            .when(inside_is(FILE), "canonical")
            .when(inside_is(STAGED), "staging")
            .when(inside_is(SHARDED), "shard")
            .otherwise("other"),
        )
        .drop("_bucket", "_path")
    )
