"""Validation of run requests kept as JSON, one per row.

Two kinds of request exist. Both may redirect a run to a trial area of the store, and
then have to name every path, all different, all inside one run-specific prefix.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.predicates import messages
from tidelake.functions.redact import is_blank, strip
from tidelake.operators.objects import SCHEME, has_odd_segment, is_strict_path

PREFIX = "qa_prefix"
COUNT = "candidates_per_user"
# Range and default of the candidate count.
COUNT_MIN, COUNT_MAX, DEFAULT_COUNT = 1, 200, "24"


@dataclass(frozen=True)
class RequestKind:
    """Keys a kind of request knows, and where its trial prefix has to lie."""

    paths: tuple[str, ...]
    other_keys: tuple[str, ...]
    namespace: str
    strict: bool

    @property
    def allowed(self) -> tuple[str, ...]:
        return (*self.other_keys, PREFIX, *self.paths)


# The keys and the reserved namespaces of both kinds.
ACTION_LOG = RequestKind(
    paths=(
        "youtube_base_path",
        "virtual_users_path",
        "action_log_output_base_path",
        "action_log_quarantine_base_path",
    ),
    other_keys=("partition_date", "overwrite", COUNT),
    namespace="(?:^|/)qa/action-log/[^/]",
    strict=False,
)
BACKFILL = RequestKind(
    paths=("source_path", "youtube_base_path"),
    other_keys=(),
    namespace="^[^/]+/qa/youtube-backfill/[^/]+$",
    strict=True,
)


def json_type(doc: Column, key: str) -> Column:
    """Type name of a key's value, NULL when the key is absent."""
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))


def _text(doc: Column, key: str) -> Column:
    """Trimmed value of a key if it is a non-blank string."""
    raw = F.try_variant_get(doc, f"$.{key}", "string")
    is_text = (json_type(doc, key) == "STRING") & ~is_blank(raw)
    return F.when(is_text, strip(raw))


def _path(doc: Column, key: str, kind: RequestKind) -> Column:
    """A path as the run would use it; strict requests keep their slash at the end."""
    text = _text(doc, key)
    return text if kind.strict else F.rtrim(text, F.lit("/"))


def _bare(path: Column) -> Column:
    """Path without the scheme, which a lax path may leave out."""
    tail = F.substring(path, len(SCHEME) + 1, 1 << 30)
    return F.when(F.startswith(path, F.lit(SCHEME)), tail).otherwise(path)


def _is_normal(path: Column, kind: RequestKind) -> Column:
    return is_strict_path(path) if kind.strict else ~has_odd_segment(_bare(path))


def _any(conditions: Iterable[Column]) -> Column:
    """True if one of the conditions is true; NULLs count as false."""
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions])


def validate_requests(df: DataFrame, kind: RequestKind, column: str = "conf") -> DataFrame:
    """Add ``errors``, in the order in which a run would stop at them."""
    doc = F.col("_doc")
    keys = F.json_object_keys(column)  # NULL unless the text is an object
    parsed = df.withColumn("_doc", F.try_parse_json(column)).withColumn("_keys", keys)
    named = {k: f"_at_{k}" for k in (PREFIX, *kind.paths)}
    parsed = parsed.withColumns({c: _path(doc, k, kind) for k, c in named.items()})

    prefix = F.col(named[PREFIX])
    paths = [F.col(named[k]) for k in kind.paths]
    trial_keys = kind.allowed if kind.strict else (PREFIX, COUNT, *kind.paths)
    flags = {
        "_trial": F.arrays_overlap("_keys", F.array(*[F.lit(k) for k in trial_keys])),
        "_unknown": F.array_except("_keys", F.array(*[F.lit(k) for k in kind.allowed])),
        "_given": F.array_compact(F.array(*paths)),
        "_normal": _is_normal(prefix, kind),
        "_reserved": F.regexp_like(_bare(prefix), F.lit(kind.namespace)),
        "_odd": _any(p.isNotNull() & ~_is_normal(p, kind) for p in paths),
        "_outside": _any(~F.startswith(p, F.concat(prefix, F.lit("/"))) for p in paths),
    }
    parsed = parsed.withColumns(flags)
    trial, normal = F.col("_trial"), F.col("_normal")
    unknown = F.array_join(F.sort_array("_unknown"), ", ")
    given = F.size("_given")
    cases = [
        (doc.isNull() | F.col("_keys").isNull(), "not a JSON object"),
        (F.size("_unknown") > 0, F.concat(F.lit("unsupported keys: "), unknown)),
        (trial & prefix.isNull(), "qa_prefix is missing"),
        (trial & prefix.isNotNull() & ~normal, "qa_prefix is not normalized"),
        (trial & normal & ~F.col("_reserved"), "qa_prefix is outside its namespace"),
        (trial & (given < len(paths)), "paths are missing"),
        (trial & (F.size(F.array_distinct("_given")) < given), "paths are not distinct"),
        (trial & F.col("_odd"), "path is not normalized"),
        (trial & F.col("_outside"), "path is outside qa_prefix"),
    ]
    if COUNT in kind.other_keys:
        cases += _count_cases(doc)
    return parsed.withColumn("errors", messages(*cases)).drop(
        "_doc", "_keys", *named.values(), *flags
    )


def resolve_requests(
    df: DataFrame,
    kind: RequestKind,
    fallbacks: Mapping[str, str],
    count: str = DEFAULT_COUNT,
    column: str = "conf",
) -> DataFrame:
    """Validated requests with the paths and the candidate count they run with.

    A trial run uses its own paths, any other run the fallbacks; a request with errors
    resolves to NULLs. Missing fallbacks are refused up front.
    """
    if set(fallbacks) != set(kind.paths):
        raise ValueError(f"fallbacks must name exactly {', '.join(kind.paths)}")
    checked = validate_requests(df, kind, column).withColumn("_doc", F.try_parse_json(column))
    valid, doc = F.size("errors") == 0, F.col("_doc")
    resolved = {}
    for key in kind.paths:
        resolved[key] = F.when(valid, F.coalesce(_path(doc, key, kind), F.lit(fallbacks[key])))
    if COUNT in kind.other_keys:
        given = strip(F.try_variant_get(doc, f"$.{COUNT}", "string"))
        resolved[COUNT] = F.when(valid, F.coalesce(given, F.lit(count)).try_cast("int"))
    return checked.withColumns(resolved).drop("_doc")


def _count_cases(doc: Column) -> list[tuple[Column, str]]:
    kind = json_type(doc, COUNT)
    raw = strip(F.try_variant_get(doc, f"$.{COUNT}", "string"))
    is_whole = (kind == "BIGINT") | ((kind == "STRING") & F.regexp_like(raw, F.lit(r"^\d+$")))
    value = raw.try_cast("decimal(38,0)")
    in_range = F.coalesce(value.between(COUNT_MIN, COUNT_MAX), F.lit(False))
    return [
        (kind.isNotNull() & ~is_whole, f"{COUNT} is not an integer"),
        (kind.isNotNull() & is_whole & ~in_range, f"{COUNT} is out of range"),
    ]
