"""Fixed-budget selectors over a context array (oldest slot first).

Each returns slots in chronological order. Short histories give short results;
padding is applied at output only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Newest-first rank intervals of the recency bands.
RECENCY_BANDS = ((1, 10), (11, 20), (21, 50), (51, 100))
_TIE_STEP = 1e-10


def check_bands(width: int, bands: Sequence[tuple[int, int]] = RECENCY_BANDS) -> None:
    covered = {r for low, high in bands for r in range(low, high + 1)}
    missing = [r for r in range(1, width + 1) if r not in covered]
    if missing:
        raise ValueError(f"recency bands leave ranks uncovered: {missing[:5]}")


def recency_band(rank: Column, bands: Sequence[tuple[int, int]] = RECENCY_BANDS) -> Column:
    """Band of a newest-first rank (1 = newest)."""
    expr = None
    for index, (low, high) in enumerate(bands):
        test = rank.between(low, high)
        expr = F.when(test, index) if expr is None else expr.when(test, index)
    return expr


def last_k(pool: Column, k: int) -> Column:
    keep = F.least(F.lit(k), F.size(pool))
    return F.slice(pool, F.size(pool) - keep + 1, keep)


def _by_priority(pool: Column, k: int, priority: Callable[[Column, Column], Column]) -> Column:
    """Top `k` by (priority, later position), back in chronological order."""
    keyed = F.transform(
        pool, lambda x, i: F.struct(priority(x, i).alias("p"), i.alias("i"), x.alias("x"))
    )
    # sort_array compares rows natively; array_sort would run an expression for each comparison
    top = F.slice(F.sort_array(keyed, asc=False), 1, k) if k > 0 else F.slice(keyed, 1, 0)
    back = F.sort_array(F.transform(top, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"))))
    return F.transform(back, lambda s: s["x"])


def predecessor_oracle(pool: Column, k: int, incident: str = "event_incident") -> Column:
    """Incident slots first, then recency. Diagnostic: reads slot labels, never the target's."""
    return _by_priority(pool, k, lambda x, i: x[incident].cast("int"))


def recent_distinct(values: Column, k: int) -> Column:
    return F.reverse(F.slice(F.array_distinct(F.reverse(values)), 1, k))


def uniform(values: Column, k: int) -> Column:
    """`k` evenly spaced values including both ends; all of them when there are no more than `k`."""
    if k == 1:
        picked = F.slice(values, 1, 1)
    else:
        # integer form of the evenly spaced position i * (n - 1) / (k - 1), truncated
        picked = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda i: F.element_at(values, (F.floor(i * (F.size(values) - 1) / F.lit(k - 1)) + 1).cast("int")),
        )
    return F.when(F.size(values) <= k, values).otherwise(picked)


def rarity(values: Column, k: int) -> Column:
    """Rarest values of the pool first (fewest copies), later position on ties."""
    # a null equals nothing
    copies = lambda x: F.coalesce(F.array_size(values) - F.array_size(F.array_remove(values, x)), F.lit(0))
    return _by_priority(values, k, lambda x, i: -copies(x))


LANDMARKS: dict[str, Callable[[Column, int], Column]] = {
    "recent_distinct": recent_distinct,
    "uniform": uniform,
    "rarity": rarity,
}


def _evidence(pool: Column, weights: Column, vocabulary: Column, bands, event: Callable[[Column], Column]):
    size = F.size(pool)

    def weight(x: Column, i: Column) -> Column:
        cell = recency_band(size - i, bands) * vocabulary + event(x)
        return F.element_at(weights, (cell + 1).cast("int"))

    return weight


def association_abs(
    pool: Column,
    k: int,
    weights: Column,
    vocabulary: Column,
    event: Callable[[Column], Column],
    bands: Sequence[tuple[int, int]] = RECENCY_BANDS,
    direction: Column | None = None,
) -> Column:
    """Top `k` slots by evidence magnitude under the target's weights.

    `weights` holds one weight per (band, local event), band-major, and `event`
    gives a slot's local event. With `direction` (+1 / -1 from the target label)
    the signed weight counts instead: that is the class oracle, a diagnostic only.
    """
    weight = _evidence(pool, weights, vocabulary, bands, event)
    size = F.size(pool)

    def priority(x: Column, i: Column) -> Column:
        evidence = F.abs(weight(x, i)) if direction is None else weight(x, i) * direction
        # positions count from the left edge of the full-width pool; newer wins a tie
        return evidence + (F.lit(bands[-1][1]) - size + i) * _TIE_STEP

    return _by_priority(pool, k, priority)


def class_oracle(pool: Column, k: int, weights: Column, vocabulary: Column, event, label: Column, **kwargs) -> Column:
    direction = F.when(label == 1, 1.0).otherwise(-1.0)
    return association_abs(pool, k, weights, vocabulary, event, direction=direction, **kwargs)


def anchored_association(
    pool: Column,
    k: int,
    anchors: int,
    weights: Column,
    vocabulary: Column,
    event: Callable[[Column], Column],
    bands: Sequence[tuple[int, int]] = RECENCY_BANDS,
) -> Column:
    """The newest `anchors` slots always, the other `k - anchors` by evidence among older slots."""
    width = bands[-1][1]
    if not 0 < anchors < k <= width:
        raise ValueError("need 0 < anchors < k <= pool width")
    size = F.size(pool)
    held = F.least(F.lit(anchors), size)
    weight = _evidence(pool, weights, vocabulary, bands, event)
    # the older part starts at the same left edge, so its slots keep their band
    older = F.slice(pool, F.lit(1), size - held)

    def priority(x: Column, i: Column) -> Column:
        return F.abs(weight(x, i)) + (F.lit(width) - size + i) * _TIE_STEP

    return F.concat(_by_priority(older, k - anchors, priority), F.slice(pool, size - held + 1, held))


def presence_within(pool: Column, caps: Sequence[int], test: Callable[[Column], Column]) -> dict[int, Column]:
    """For each cap, whether a slot among the newest `cap` passes `test`."""
    return {cap: F.exists(last_k(pool, cap), test) for cap in caps}
