"""Counter-based random draws: the same seed gives the same draw on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burdenframe.functions.numeric import let

HASH_DIGITS = 15  # hexadecimal digits of md5 kept, so that the value fits a signed 64-bit integer


def hash_hex(seed: int | str, *parts: Column) -> Column:
    """md5 text of ``seed:part:part...``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_draw(seed: int | str, *parts: Column) -> Column:
    """Non-negative 60-bit integer drawn from the hash of the parts."""
    return F.conv(F.substring(hash_hex(seed, *parts), 1, HASH_DIGITS), 16, 10).cast("bigint")


def distinct_draws(seed: int | str, counter: Column, n: Column, k: Column) -> Column:
    """``k`` distinct indices out of ``0..n-1`` for one counter value, ``k`` at most ``n``.

    Floyd's rule: for ``j`` from ``n-k`` to ``n-1`` draw from ``0..j`` and take ``j`` itself if the draw is there already. All
    subsets are equally likely, whatever ``n``.
    """

    def step(taken: Column, i: Column) -> Column:
        last = n.cast("int") - k + i
        draw = (hash_draw(seed, counter, i) % (last + 1)).cast("int")
        return let(draw, lambda d: F.array_append(taken, F.when(F.array_contains(taken, d), last).otherwise(d)))

    none = F.array().cast("array<int>")
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(0), k - 1), none, step)).otherwise(none)
