"""Predicates and hashes used by several operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 1 << 32


def any_null(columns: Sequence[str]) -> Column:
    """True when at least one of the columns is NULL."""
    return reduce(or_, [F.col(c).isNull() for c in columns])


def none_null(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def md5_number(*parts: Column | str | int) -> Column:
    """Engine-independent hash in ``[0, 2**32)`` of the parts joined by ``|``."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def messages(*cases: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose condition holds, in the order given."""
    return F.array_compact(
        F.array(*[F.when(cond, m if isinstance(m, Column) else F.lit(m)) for cond, m in cases])
    )
