"""Exposure mix, click decision and threshold calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.predicates import HASH_SPAN, md5_number
from tidelake.operators.ranking import ordered_limit, top_n

MAX_CANDIDATES = 200
#: Hash ranges that positions are counted in; they spread the work and change nothing else.
POSITION_RANGES = 4_096
#: Steps of a walk back into the catalog, and the prime of its round functions.
WALK_STEPS = 16
PRIME = (1 << 31) - 1
ROUNDS = 4


@dataclass(frozen=True)
class Mix:
    """Shares of one user's candidate list. Rounding leaves go to the first share."""

    # List length, the three shares and the seed.
    n: int = 24
    personalized: float = 0.7
    popular: float = 0.2
    exploration: float = 0.1
    seed: int = 42

    def __post_init__(self) -> None:
        if isinstance(self.n, bool) or not 1 <= self.n <= MAX_CANDIDATES:
            raise ValueError(f"n must be between 1 and {MAX_CANDIDATES}: {self.n}")
        shares = (self.personalized, self.popular, self.exploration)
        if min(shares) < 0 or abs(sum(shares) - 1) > 1e-9:
            raise ValueError(f"shares must be non-negative and add up to 1: {shares}")

    @property
    def quotas(self) -> tuple[int, int, int]:
        popular = int(self.n * self.popular + 0.5)
        exploration = min(int(self.n * self.exploration + 0.5), self.n - popular)
        return self.n - popular - exploration, popular, exploration


def _ids(df: DataFrame, rank: str, key: str) -> DataFrame:
    """Ranked ids of each key as one array; the rank bounds its length."""
    ranked = F.sort_array(F.collect_list(F.struct(rank, "video_id")))
    return df.groupBy(key).agg(ranked["video_id"].alias("ids"))


def positions(items: DataFrame, seed: int, ranges: int = POSITION_RANGES) -> DataFrame:
    """(video_id, position): the catalog numbered from 0 in a seeded random order.

    Positions come from counts per hash range plus a rank inside each range, so no
    task sees the whole catalog.
    """
    hashed = items.select("video_id", md5_number(F.col("video_id"), seed).alias("_hash")).withColumn(
        "_range", F.floor(F.col("_hash") * ranges / HASH_SPAN)
    )
    # at most one row per range, a fixed number
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_range").orderBy("_hash", "video_id")
    return (
        hashed.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")
        .select("video_id", (F.col("_offset") + F.col("_rank") - 1).alias("position"))
    )


def permuted(index: Column, keys: Sequence[tuple[Column, Column]], total: Column) -> Column:
    """Where a keyed permutation of ``0 .. total-1`` puts an index.

    A Feistel network over a grid of about the square root of ``total`` on each side: one
    coordinate is moved by a keyed function of the other, in turns, which can be undone
    and so never merges two places. The few cells of the grid behind ``total`` are walked
    through until a place inside is met. They are fewer than a side, so a walk ends
    within 16 steps for up to 256 items, and otherwise ends later with a chance below 1e-19.
    """
    side = F.greatest(F.ceil(F.sqrt(total)), F.lit(1)).cast("long")
    rows = F.ceil(total / side).cast("long")

    def once(place: Column) -> Column:
        left, right = F.floor(place / side).cast("long"), place % side
        for n, (add, times) in enumerate(keys):
            moved, by, size = (left, right, rows) if n % 2 == 0 else (right, left, side)
            moved = (moved + ((by + add) % PRIME) * times % PRIME) % size
            left, right = (moved, right) if n % 2 == 0 else (left, moved)
        return left * side + right

    first = once(index)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK_STEPS)),
        first,
        lambda place, _: F.when(place < total, place).otherwise(once(place)),
    )
    return F.when(first < total, first).otherwise(walked)  # few places need a walk


def user_keys(seed: int) -> list[tuple[Column, Column]]:
    """The round keys of each user's own permutation."""
    user = F.col("user_id")
    return [
        (md5_number(user, seed, f"add{n}") % PRIME, md5_number(user, seed, f"times{n}") % (PRIME - 1) + 1)
        for n in range(ROUNDS)
    ]


def walks(users: DataFrame, items: DataFrame, n: int, seed: int) -> DataFrame:
    """(user_id, _walk): the first ``n`` items of each user's own order of the whole catalog.

    Users draw positions and meet the items by an equi join; positions are spread evenly,
    so no item is hot.
    """
    names = [f"_{kind}{r}" for r in range(ROUNDS) for kind in ("add", "times")]
    keys = [column for pair in user_keys(seed) for column in pair]
    total = items.agg(F.count(F.lit(1))).scalar()
    own = users.select("user_id").distinct().select("user_id", *[k.alias(c) for k, c in zip(keys, names)])
    drawn = own.withColumn("_total", total).select(
        "user_id", "_total", *names, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias("_i")
    )
    pairs = [(F.col(f"_add{r}"), F.col(f"_times{r}")) for r in range(ROUNDS)]
    placed = drawn.where(F.col("_i") < F.col("_total")).select(
        "user_id", "_i", permuted(F.col("_i"), pairs, F.col("_total")).alias("position")
    )
    met = placed.join(positions(items, seed), "position")
    in_order = F.sort_array(F.collect_list(F.struct("_i", "video_id")))
    return met.groupBy("user_id").agg(in_order["video_id"].alias("_walk"))


def quota_mix(users: DataFrame, items: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``mix.n`` distinct candidates per user, fewer only if the catalog is smaller.

    ``users`` has ``user_id`` and a preferred ``category`` (or NULL), ``items`` has
    ``video_id``, ``category`` and ``score``. Personalized picks are the best of the
    category, popular ones the best overall, and exploration walks the whole catalog in
    an order of the user's own. A later strategy skips what an earlier one took, and
    exploration fills what they could not: among ``n`` items of the walk there are always
    enough. Nothing runs while the plan is made, and users never meet the catalog itself.
    """
    personalized, popular, _ = mix.quotas
    best = [F.desc_nulls_last("score"), F.col("video_id")]
    in_category = items.where(F.col("category").isNotNull())
    by_category = _ids(top_n(in_category, ["category"], best, max(personalized, 1)), "rank", "category")
    # personalized + popular ids at most
    place = F.struct(F.coalesce(F.col("score"), F.lit(float("-inf"))).alias("s"), F.col("video_id"))
    top = ordered_limit(items.select("video_id", "score"), best, personalized + popular)
    ranked = F.array_sort(
        F.collect_list(place),
        lambda x, y: F.when(x["s"] > y["s"], -1).when(x["s"] < y["s"], 1)
        .when(x["video_id"] < y["video_id"], -1).otherwise(1),
    )
    top_ids = top.agg(F.transform(ranked, lambda r: r["video_id"])).scalar()

    id_type = items.schema["video_id"].dataType
    none = F.array().cast(f"array<{id_type.simpleString()}>")
    own = walks(users, items, mix.n, mix.seed).withColumnRenamed("user_id", "_user")
    people = users.select("user_id", "category")
    picked = (
        people.join(by_category.withColumnRenamed("ids", "_mine"), "category", "left")
        .join(own, F.col("user_id").eqNullSafe(F.col("_user")), "left")
        .withColumn("_p", F.slice(F.coalesce("_mine", none), 1, personalized))
        .withColumn("_q", F.slice(F.array_except(F.coalesce(top_ids, none), "_p"), 1, popular))
        .withColumn("_taken", F.concat("_p", "_q"))
        .withColumn(
            "_e",
            F.slice(
                F.array_except(F.coalesce("_walk", none), "_taken"),
                F.lit(1),
                F.lit(mix.n) - F.size("_taken"),
            ),
        )
    )

    def tagged(ids: str, strategy: str) -> Column:
        return F.transform(
            ids, lambda v: F.struct(v.alias("video_id"), F.lit(strategy).alias("strategy"))
        )

    rows = F.concat(
        tagged("_p", "personalized"), tagged("_q", "popular"), tagged("_e", "exploration")
    )
    return picked.select("user_id", F.posexplode(rows).alias("_slot", "_pick")).select(
        "user_id",
        (F.col("_slot") + 1).alias("slot"),
        "_pick.video_id",
        "_pick.strategy",
    )


def decide_click(df: DataFrame, score: str, threshold: float | None) -> DataFrame:
    """Add ``clicked``. There is no default threshold: an unset one stops the job."""
    if threshold is None:
        raise ValueError("the click threshold must be calibrated and set")
    return df.withColumn("clicked", F.coalesce(F.col(score) >= F.lit(threshold), F.lit(False)))


def threshold_sweep(df: DataFrame, score: str, grid: Sequence[float]) -> DataFrame:
    """Exposures, clicks and CTR at every threshold of the grid, in one scan."""
    totals = df.agg(
        F.count(F.lit(1)).alias("exposures"),
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    F.count_if(F.col(score) >= F.lit(float(t))).alias("clicks"),
                )
                for t in grid
            ]
        ).alias("_grid"),
    )
    return totals.select("exposures", F.explode("_grid").alias("_at")).select(
        "_at.threshold",
        "exposures",
        "_at.clicks",
        F.try_divide("_at.clicks", "exposures").alias("ctr"),
    )


def threshold_choice(sweep: DataFrame, target: float) -> DataFrame:
    """The threshold whose CTR is closest to the target; the lower one on a tie."""
    distance = F.abs(F.col("ctr") - F.lit(target))
    return sweep.where(F.col("ctr").isNotNull()).orderBy(distance, "threshold").limit(1)
