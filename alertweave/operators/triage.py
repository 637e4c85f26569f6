"""Patterns, fingerprints, density clusters and triage.

Fingerprints are integer vectors in units of 1e-4, kept as event-sorted arrays of
`(e, w)`, so equal fingerprints group and distances are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions import encode as E
from alertweave.functions.hashing import seeded_key
from alertweave.functions.ratios import clip
from alertweave.operators.ordering import running_position, take_smallest
from alertweave.operators.select import recency_band
from alertweave.session import cut_lineage

UNIT = 10_000
_ROUNDING_SLACK = 100
#: Fingerprints of so many features at most meet on one decisive feature or on two shared ones.
NARROW = 4
#: Up to so many different weights of one set of features, stored fingerprints are looked up by what they may share with a query.
WEIGHTINGS = 512


# ---- patterns and fingerprints ----------------------------------------------------


def compact_patterns(
    rows: DataFrame, max_multiplicity: int = 5, label: str = "label", revealed: str | None = None, keys: Sequence[str] = (),
    count: str | None = None,
) -> DataFrame:
    """Distinct (context, target) with row count, capped count and the largest label; `count`: how many rows a row stands for.

    With `revealed` only flagged rows give a label; a pattern without one gets -9.
    Capping at the core size keeps every density-core decision.
    """
    value = F.col(label) if revealed is None else F.when(F.col(revealed), F.col(label))
    n = F.count("*") if count is None else F.sum(count)
    return rows.groupBy(*keys, "event_id", "context").agg(
        n.alias("n"),
        F.least(n, F.lit(max_multiplicity)).alias("weight"),
        F.coalesce(F.max(value), F.lit(E.UNLABELLED)).alias("label"),
    )


def expand_multiplicity(patterns: DataFrame) -> DataFrame:
    """One row per kept copy of a pattern, for display; operators use the weight column."""
    copies = F.sequence(F.lit(1).cast("long"), F.col("weight"))
    return patterns.withColumn("copy", F.explode(copies))


def slot_weights(width: int, scheme: str = "uniform") -> list[float]:
    """Weights of the slots, oldest first, with sum 1."""
    if scheme == "uniform":
        raw = [1.0] * width
    elif scheme == "recency":
        raw = [2.0 ** i for i in range(width)]
    else:
        raise ValueError(f"unknown weight scheme {scheme!r}")
    return [r / sum(raw) for r in raw]


def fingerprint(padded: Column, weights: Sequence[float] | Column) -> Column:
    """Slot weight per event of a full-width context (padding is an event of its own), rounded, zeros dropped.

    `weights` may be a column with one array per row (association-weighted slots).
    """
    w = weights if isinstance(weights, Column) else F.array(*[F.lit(float(x)) for x in weights])
    paired = F.arrays_zip(padded.alias("e"), w.alias("w"))

    def mass(event: Column) -> Column:
        total = F.aggregate(
            paired, F.lit(0.0), lambda acc, s: acc + F.when(s["e"] == event, s["w"]).otherwise(0.0)
        )
        return F.round(total * UNIT).cast("int")

    entries = F.transform(
        F.array_sort(F.array_distinct(padded)), lambda e: F.struct(e.alias("e"), mass(e).alias("w"))
    )
    return F.filter(entries, lambda s: s["w"] > 0)


def association_slot_weights(evidence: Column) -> Column:
    """Slot weights proportional to the evidence magnitude, uniform when there is none."""
    total = F.aggregate(evidence, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.transform(
        evidence, lambda x: F.when(total > 0, F.abs(x) / total).otherwise(F.lit(1.0) / F.size(evidence))
    )


def mass(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0), lambda a, s: a + s["w"])


def l1_distance(a: Column, b: Column) -> Column:
    """L1 distance of two fingerprints in units: both masses less twice the shared mass."""
    lookup = F.map_from_entries(b)
    shared = F.aggregate(a, F.lit(0), lambda acc, s: acc + F.least(s["w"], F.coalesce(F.try_element_at(lookup, s["e"]), F.lit(0))))
    return mass(a) + mass(b) - 2 * shared


# ---- next-event confidence ---------------------------------------------------------------


def next_event_counts(train: DataFrame, bands: Sequence[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Training counts behind P(target | slot event, band); `train` has distinct `event_id, padded` with row counts `n`."""
    width = F.size("padded")
    slots = train.select("event_id", "n", F.posexplode("padded").alias("i", "slot"), width.alias("_w"))
    banded = slots.select("event_id", "n", "slot", recency_band(F.col("_w") - F.col("i"), bands).alias("band"))
    pairs = banded.groupBy("band", "slot", "event_id").agg(F.sum("n").alias("pair_n"))
    return pairs, pairs.groupBy("band", "slot").agg(F.sum("pair_n").alias("slot_n"))


def next_event_confidence(
    patterns: DataFrame, pairs: DataFrame, slots: DataFrame, vocabulary: DataFrame, weights: Sequence[float],
    bands: Sequence[tuple[int, int]],
) -> DataFrame:
    """Slot-weighted smoothed probability of the target given its context, per distinct pattern.

    `patterns` has `pattern_id, event_id, padded`; `vocabulary` is one row with `size`.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    width = len(weights)
    exploded = patterns.select("pattern_id", "event_id", F.posexplode("padded").alias("i", "slot")).select(
        "pattern_id", "event_id", "slot",
        recency_band(F.lit(width) - F.col("i"), bands).alias("band"),
        F.element_at(w, F.col("i") + 1).alias("_w"),
    )
    looked = exploded.join(slots, ["band", "slot"], "left").join(pairs, ["band", "slot", "event_id"], "left")
    looked = looked.withColumn("_one", F.lit(1)).join(vocabulary.withColumn("_one", F.lit(1)), "_one")
    p = (F.coalesce("pair_n", F.lit(0)) + 1.0) / (F.coalesce("slot_n", F.lit(0)) + F.col("size"))
    summed = looked.groupBy("pattern_id").agg(F.sum(F.col("_w") * p).alias("confidence"))
    return patterns.join(summed, "pattern_id")


def confidence_gate(confidence: Column, threshold: float, passed: Column) -> Column:
    return F.when(confidence < threshold, E.NOT_CONFIDENT).otherwise(passed)


# ---- similarity join -------------------------------------------------------------------------


def _frequencies(vectors: DataFrame) -> DataFrame:
    features = vectors.select("event_id", F.explode("vector.e").alias("f"))
    return features.groupBy("event_id", "f").agg(F.count("*").alias("_df"))


def _prefixed(vectors: DataFrame, order: DataFrame, reach: int) -> DataFrame:
    """Rows per prefix feature: the rarest features up to where the rest cannot reach the shared mass.

    Fingerprints with mass about 1 and distance <= reach share at least
    (mass + UNIT - slack - reach) / 2; the first feature they share, rarest first,
    lies in both prefixes.
    """
    entries = vectors.select("id", "event_id", F.explode("vector").alias("s")).select(
        "id", "event_id", F.col("s.e").alias("f"), F.col("s.w").alias("w")
    ).join(order, ["event_id", "f"])
    ranked = entries.groupBy("id", "event_id").agg(
        F.array_sort(F.collect_list(F.struct("_df", "f", "w"))).alias("_o"), F.sum("w").alias("_mass")
    )
    need = (F.col("_mass") + UNIT - _ROUNDING_SLACK - reach) / 2

    def rest_from(i: Column) -> Column:
        return F.aggregate(F.slice("_o", i + 1, F.size("_o")), F.lit(0).cast("long"), lambda a, s: a + s["w"])

    prefix = F.filter("_o", lambda s, i: rest_from(i) >= need)
    return ranked.select("id", prefix.alias("_prefix"))


def _cells(vector: Column, width: int, projections: int) -> list[Column]:
    """Coordinates that move by at most `width` within reach: masses of hashed event subsets."""
    out = []
    for j in range(projections):
        share = F.aggregate(
            vector, F.lit(0), lambda a, s: a + F.when(F.pmod(F.xxhash64(s["e"], F.lit(j)), F.lit(2)) == 0, s["w"]).otherwise(0)
        )
        out.append(F.floor(share / width))
    return out


def _narrow_side(vectors: DataFrame, order: DataFrame, prefix: str, size: int, least: int, reach: int, apart: str | None) -> DataFrame:
    """Narrow fingerprints with their keys `_m`: features `f, g` (equal: one alone suffices), the place of `g` and the weight of `f`.

    Features stand rarest first in columns. A key is kept if its features and those after `g` hold the mass
    that a pair within reach must share with a fingerprint of the mass `least`.
    """
    entries = vectors.select("id", "event_id", F.explode("vector").alias("s")).select("id", "event_id", F.col("s.e").alias("f"), F.col("s.w").alias("w"))
    ranked = entries.join(order, ["event_id", "f"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_df", "f", "w"))).alias("_o"))
    f, w = ([F.get("_o", F.lit(i))[name] for i in range(size)] for name in ("f", "w"))
    rest = [sum((F.coalesce(x, F.lit(0)) for x in w[i + 1 :]), F.coalesce(w[i], F.lit(0))) for i in range(size)]
    need = (rest[0] + least - reach) / 2
    key = lambda i, j: F.struct(f[i].alias("f"), f[j].alias("g"), F.lit(j).alias("at"), w[i].alias("w"))
    keys = [F.when(w[i] >= need, key(i, i)) for i in range(size)]
    keys += [F.when(w[j].isNotNull() & (w[i] + rest[j] >= need), key(i, j)) for i in range(size) for j in range(i + 1, size)]
    extra = vectors.select("id", "event_id", *([F.col(apart).alias(f"{prefix}_apart")] if apart else []))
    columns = [c.alias(f"{prefix}_{name}{i}") for name, cs in (("f", f), ("w", w)) for i, c in enumerate(cs)]
    rows = extra.join(ranked, "id").select(
        F.col("id").alias(f"{prefix}_id"), *[c for c in extra.columns if c != "id"], *columns, rest[0].alias(f"{prefix}_mass"), F.explode(F.array_compact(F.array(*keys))).alias("_m")
    )
    return rows.select("*", F.col("_m.f").alias("_f"), F.col("_m.g").alias("_g"), F.col("_m.at").alias("_at"), F.col("_m.w").alias("_w")).drop("_m")


def _narrow_pairs(left: DataFrame, right: DataFrame, order: DataFrame, size: int, least: int, reach: int, apart: str | None, settled: str | None) -> DataFrame:
    """Pairs of narrow fingerprints within reach, each met once: with one common feature under it, with more under the rarest two.

    With `settled`, a feature whose fingerprints are known to be neighbours, these do not meet under it alone.
    """
    here = _narrow_side(left, order, "left", size, least, reach, apart)
    there = _narrow_side(right, order, "right", size, least, reach, apart).drop("_at")
    keys = ["event_id", "_f", "_g"]
    width = (reach + _ROUNDING_SLACK) // 2 + 1
    if (UNIT + _ROUNDING_SLACK) // width >= 4:
        # within a short reach the weight of a feature settles much
        cell = F.floor(F.col("_w") / width)
        here, there = here.withColumn("_cw", cell), there.withColumn("_cw", F.explode(F.array(cell - 1, cell, cell + 1)))
        keys.append("_cw")
    if settled:
        own = lambda side: F.coalesce((F.col("_f") == F.col("_g")) & (F.col(f"{side}_apart.{settled}") == F.col("_f")), F.lit(False))
        here = here.withColumn("_own", own("left").cast("int"))
        there = there.withColumn("_own", F.explode(F.when(own("right"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
        keys.append("_own")
    met = here.drop("_w").join(there.drop("_w"), keys)
    if apart:
        met = met.filter("NOT left_apart <=> right_apart" + (" OR left_id = right_id" if left is right else ""))
    column = lambda side, name, i: F.col(f"{side}_{name}{i}")
    common = [F.coalesce(reduce(Column.__or__, [column("left", "f", i) == column("right", "f", j) for j in range(size)]).cast("int"), F.lit(0)) for i in range(size)]
    earlier = sum((F.when(F.col("_at") > i, common[i]).otherwise(0) for i in range(size)), F.lit(0))
    met = met.filter(F.when(F.col("_f") == F.col("_g"), sum(common, F.lit(0)) == 1).otherwise(earlier == 1))
    shared = sum(
        (F.when(column("left", "f", i) == column("right", "f", j), F.least(column("left", "w", i), column("right", "w", j))).otherwise(0) for i in range(size) for j in range(size)),
        F.lit(0),
    )
    distance = F.col("left_mass") + F.col("right_mass") - 2 * shared
    return met.select("event_id", "left_id", "right_id", distance.alias("distance")).filter(F.col("distance") <= reach)


def _measures(*tables: DataFrame) -> tuple[int, int, int]:
    """Most features, least and most mass of the fingerprints."""
    every = reduce(DataFrame.unionByName, [t.select("vector") for t in tables])
    most = every.agg(F.max(F.size("vector")).alias("size"), F.min(mass(F.col("vector"))).alias("least"), F.max(mass(F.col("vector"))).alias("most")).first()
    return most["size"] or 0, most["least"] or 0, most["most"] or 0


def neighbour_pairs(left: DataFrame, right: DataFrame, eps: float, projections: int = 2, apart: str | None = None) -> DataFrame:
    """All pairs `(left_id, right_id, distance)` of the same event with L1 distance <= eps.

    Narrow fingerprints meet on one feature that suffices alone, or on two shared features. Wider ones
    meet on (event, shared prefix feature, weight cell, projection cells): the
    weight of a feature, and the mass of any event subset, differ by at most half
    the distance, so the right side visits the neighbouring cells. Let it be the smaller
    one. A pair is verified only under its first common prefix feature, so it appears
    once. With `apart` pairs equal in that column are left out. Hot cells are split by the adaptive skew join.
    """
    reach = int(round(eps * UNIT))
    width = (reach + _ROUNDING_SLACK) // 2 + 1
    last = (UNIT + _ROUNDING_SLACK) // width
    order = cut_lineage(_frequencies(left.select("event_id", "vector").unionByName(right.select("event_id", "vector"))))
    twins = left is right
    size, least, _ = _measures(left) if twins else _measures(left, right)
    if 0 < size <= NARROW:
        return _narrow_pairs(left, right, order, size, least, reach, apart, None)

    def side(vectors: DataFrame, prefix: str) -> DataFrame:
        rows = vectors.join(_prefixed(vectors, order, reach), "id")
        return rows.select(
            F.col("id").alias(f"{prefix}_id"),
            "event_id",
            *([F.col(apart).alias(f"{prefix}_apart")] if apart else []),
            # what the distance needs, computed once per fingerprint and not per pair
            (F.col("vector") if prefix == "left" else F.map_from_entries("vector")).alias(f"{prefix}_vector"),
            mass(F.col("vector")).alias(f"{prefix}_mass"),
            F.transform("_prefix", lambda s: s["f"]).alias(f"{prefix}_features"),
            F.explode("_prefix").alias("_s"),
            *[c.alias(f"_c{j}") for j, c in enumerate(_cells(F.col("vector"), width, projections))],
        ).select("*", F.col("_s.f").alias("_f"), F.floor(F.col("_s.w") / width).alias("_cw")).drop("_s")

    here = side(left, "left")
    there = side(right, "right")
    for name in ["_cw", *[f"_c{j}" for j in range(projections)]]:
        around = F.filter(F.array(*[F.col(name) + d for d in (-1, 0, 1)]), lambda c: (c >= 0) & (c <= last))
        there = there.withColumn(name, F.explode(around))
    met = here.join(there, ["event_id", "_f", "_cw", *[f"_c{j}" for j in range(projections)]])
    if twins:
        met = met.filter("left_id <= right_id")
    if apart:
        met = met.filter("NOT left_apart <=> right_apart" + (" OR left_id = right_id" if twins else ""))
    first_common = F.element_at(F.array_intersect("left_features", "right_features"), 1)
    met = met.filter(first_common == F.col("_f"))
    shared = F.aggregate(
        "left_vector", F.lit(0),
        lambda acc, s: acc + F.least(s["w"], F.coalesce(F.try_element_at("right_vector", s["e"]), F.lit(0))),
    )
    distance = F.col("left_mass") + F.col("right_mass") - 2 * shared
    found = met.select("event_id", "left_id", "right_id", distance.alias("distance")).filter(F.col("distance") <= reach)
    if not twins:
        return found
    both = F.when(F.col("left_id") == F.col("right_id"), F.array(F.struct("left_id", "right_id"))).otherwise(
        F.array(F.struct("left_id", "right_id"), F.struct(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    )
    return found.select("event_id", "distance", F.inline(both)).select("event_id", "left_id", "right_id", "distance")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`id, component`: the smallest id reachable over undirected edges.

    Each round takes the smallest label among the neighbours, then the label of
    that label (pointer jumping), and is checkpointed. Rounds go on until no label
    changes; labels only fall, so they end.
    """
    both = cut_lineage(
        edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        .unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        .filter("a <> b")
        .distinct()
    )
    labels = nodes.select("id", F.col("id").alias("component"))
    while True:
        offered = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("_offer"))
        nearer = labels.join(offered, labels["id"] == offered["a"], "left").select(
            "id", F.col("component").alias("_old"), F.least("component", F.coalesce("_offer", "component")).alias("_new")
        )
        roots = nearer.select(F.col("id").alias("_root"), F.col("_new").alias("_jump"))
        jumped = cut_lineage(
            nearer.join(roots, nearer["_new"] == roots["_root"]).select("id", "_old", F.least("_new", "_jump").alias("component"))
        )
        changed = jumped.filter("component <> _old").limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels


def numbered_vectors(patterns: DataFrame) -> DataFrame:
    """Distinct fingerprints per event with a dense id and their summed multiplicity."""
    vectors = patterns.groupBy("event_id", "vector").agg(F.sum("weight").alias("weight"))
    return cut_lineage(running_position(vectors, [], ["event_id", "vector"], "id"))


def _heavy_cell(vector: Column, reach: int) -> Column:
    """Key of a cell whose members lie within reach of each other: the heaviest events that all but settle a fingerprint.

    Weights are lowered to multiples of a step. Members agree in the lowered weights
    of the key, and these come within half the reach of each member's mass, so
    members share enough mass whatever else they hold.
    """
    most = F.greatest(F.floor(F.lit(reach) / (2 * F.greatest(F.size(vector), F.lit(1)))), F.lit(1))
    step = F.pow(F.lit(2), F.floor(F.log2(most))).cast("int")
    ordered = F.array_sort(F.transform(vector, lambda s: F.struct((-s["w"]).alias("n"), s["e"].alias("e"), F.floor(s["w"] / step).cast("int").alias("q"))))
    need = mass(vector) - F.floor(F.lit(reach) / 2)
    start = F.struct(F.lit(0).alias("sum"), F.expr("CAST(array() AS array<struct<e:int,q:int>>)").alias("key"))
    taken = F.aggregate(
        ordered, start,
        lambda a, s: F.when(a["sum"] >= need, a).otherwise(
            F.struct(
                (a["sum"] + s["q"] * step).cast("int").alias("sum"),
                F.concat(a["key"], F.array(F.struct(s["e"].cast("int").alias("e"), s["q"].alias("q")))).alias("key"),
            )
        ),
    )
    return F.struct(step.alias("step"), F.array_sort(taken["key"]).alias("key"))


def core_points(vectors: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """`id, neighbourhood, core`: multiplicity within eps, the point itself included."""
    weights = vectors.select(F.col("id").alias("right_id"), F.col("weight").alias("_w"))
    counted = pairs.join(weights, "right_id").groupBy(F.col("left_id").alias("id")).agg(F.sum("_w").alias("neighbourhood"))
    return counted.withColumn("core", F.col("neighbourhood") >= min_samples)


def neighbourhoods(vectors: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """`core_points` of all fingerprints against each other, without a list of all pairs where they are narrow.

    Fingerprints of one event that give a feature all but half the reach of the largest mass are neighbours whatever
    else they hold: they are counted together. Pairs are listed across such groups only.
    """
    reach = int(round(eps * UNIT))
    size, least, most = _measures(vectors)
    if not 0 < size <= NARROW:
        return core_points(vectors, neighbour_pairs(vectors, vectors, eps), min_samples)
    heaviest = F.array_max(F.transform("vector", lambda s: F.struct(s["w"].alias("w"), s["e"].alias("e"))))
    solid = F.when(heaviest["w"] >= most - reach // 2, heaviest["e"])
    grouped = cut_lineage(vectors.select("id", "event_id", "vector", "weight", F.struct(solid.alias("solid"), F.when(solid.isNull(), F.col("id")).alias("alone")).alias("_group")))
    across = _narrow_pairs(grouped, grouped, cut_lineage(_frequencies(grouped)), size, least, reach, "_group", "solid").filter("left_id <> right_id")
    weights = grouped.select(F.col("id").alias("right_id"), F.col("weight").alias("_w"))
    beside = across.join(weights, "right_id").groupBy(F.col("left_id").alias("id")).agg(F.sum("_w").alias("_beside"))
    whole = grouped.groupBy("event_id", "_group").agg(F.sum("weight").alias("_own"))
    counted = grouped.select("id", "event_id", "_group").join(whole, ["event_id", "_group"]).join(beside, "id", "left")
    counted = counted.select("id", (F.col("_own") + F.coalesce("_beside", F.lit(0))).alias("neighbourhood"))
    return counted.withColumn("core", F.col("neighbourhood") >= min_samples)


def density_cluster(vectors: DataFrame, eps: float = 0.10, min_samples: int = 5) -> DataFrame:
    """L1 density clusters per event: `id, event_id, core, cluster` (cluster = smallest core id, noise = -1).

    `vectors` come from `numbered_vectors`. A cell whose members lie within reach of
    each other and weigh enough is core throughout and part of one cluster. Such
    cells are joined by witnesses: first every member against the heads of the other cells, then
    only members of what is still apart, without those of each event's largest component
    among themselves. Pairs are listed for fingerprints outside such cells alone:
    they give their neighbourhood, their links and the border. A border point joins its lowest adjacent cluster.
    """
    reach = int(round(eps * UNIT))
    # the cell itself is the key: a hash of it could merge two clusters
    members = cut_lineage(vectors.withColumn("_cell", _heavy_cell(F.col("vector"), reach)))
    by_cell = members.groupBy("event_id", "_cell").agg(F.sum("weight").alias("_cw"), F.min("id").alias("_head"))
    dense = by_cell.filter(F.col("_cw") >= min_samples).select("_cell", "event_id", "_head")
    placed = cut_lineage(members.join(dense, ["event_id", "_cell"], "left").select("id", "event_id", "vector", "weight", "_head"))
    settled = placed.filter("_head IS NOT NULL").drop("weight")
    loose = placed.filter("_head IS NULL")

    # witnesses of a member for the head of another cell
    heads = settled.filter("id = _head")
    seen = neighbour_pairs(settled, heads, eps, apart="_head").select(F.col("left_id").alias("id"), F.col("right_id").alias("dst"))
    edges = cut_lineage(seen.join(settled.select("id", "_head"), "id").select(F.col("_head").alias("src"), "dst").distinct())
    joined = connected_components(edges, heads.select("id"))
    parts = cut_lineage(settled.join(joined.withColumnRenamed("id", "_head"), "_head"))
    # what is still apart: one side at least lies outside the largest component of its event
    sizes = parts.groupBy("event_id", "component").count()
    largest = sizes.groupBy("event_id").agg(F.max(F.struct("count", "component"))["component"].alias("component"))
    rest = parts.join(largest, ["event_id", "component"], "left_anti").select(*parts.columns)
    met = neighbour_pairs(parts, rest, eps, apart="component").select(F.col("left_id").alias("id"), "right_id")
    named = parts.select("id", "component")
    far = met.join(named, "id").join(named.select(F.col("id").alias("right_id"), F.col("component").alias("dst")), "right_id")
    witnesses = far.select(F.col("component").alias("src"), "dst").distinct()

    # fingerprints outside such cells list their neighbours
    listed = neighbour_pairs(placed, loose, eps).select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    pairs = cut_lineage(listed)
    counted = core_points(placed, pairs, min_samples)
    flags = cut_lineage(
        placed.join(counted.select("id", F.col("core").alias("_c")), "id", "left").select(
            "id", "event_id", "_head", (F.col("_head").isNotNull() | F.coalesce("_c", F.lit(False))).alias("core")
        )
    )
    # components of what stands for the core: a component of cells, or a core fingerprint of its own
    core = flags.filter("core").select("id")
    stands = cut_lineage(core.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("_for")))
    touching = pairs.join(core.withColumnRenamed("id", "right_id"), "right_id")
    ends = touching.join(stands.select(F.col("id").alias("left_id"), F.col("_for").alias("src")), "left_id")
    links = ends.join(stands.select(F.col("id").alias("right_id"), F.col("_for").alias("dst")), "right_id").select("src", "dst")
    over = connected_components(links.unionByName(witnesses).filter("src <> dst").distinct(), stands.select(F.col("_for").alias("id")).distinct())
    components = cut_lineage(stands.join(over.withColumnRenamed("id", "_for"), "_for").select("id", "component"))
    border = (
        touching.join(components.withColumnRenamed("id", "right_id"), "right_id")
        .groupBy(F.col("left_id").alias("id"))
        .agg(F.min("component").alias("_adjacent"))
    )
    return (
        flags.join(components, "id", "left")
        .join(border, "id", "left")
        .select("id", "event_id", "core", F.coalesce("component", "_adjacent", F.lit(-1)).alias("cluster"))
    )


# ---- scores ---------------------------------------------------------------------------------------


SCORE_STRATEGIES = {
    "max": F.max,
    "min": F.min,
    # half-even, as a float mean rounds
    "avg": lambda c: F.bround(F.avg(c)).cast("int"),
}


def score_clusters(
    rows: DataFrame, strategy: str = "max", no_label: int = E.NO_ATTACK, unlabelled: int = E.BENIGN_CLUSTER, keys: Sequence[str] = ()
) -> DataFrame:
    """`cluster, score` from the labels inside each cluster; a cluster without labels gets `unlabelled`."""
    labels = F.when(F.col("label") != no_label, F.col("label"))
    scored = rows.filter("cluster <> -1").groupBy(*keys, "cluster").agg(SCORE_STRATEGIES[strategy](labels).alias("_s"))
    return scored.select(*keys, "cluster", F.coalesce("_s", F.lit(unlabelled)).cast("int").alias("score"))


def with_cluster_score(rows: DataFrame, scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Scores back on the rows; noise stays -1."""
    return rows.join(scores, [*keys, "cluster"], "left").withColumn("score", F.coalesce("score", F.lit(E.NO_ATTACK)))


def posterior_clusters(
    rows: DataFrame, positive_weight: float, negative_weight: float, low: float, high: float, weight: str | None = None
) -> DataFrame:
    """`cluster, prior, score`: weighted incident share of each cluster and its 1 / 0 / -5 decision.

    Noise (cluster -1) is undecided: prior 0.5 and -5, one row if there is any.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    incident = F.col("label") != E.NO_ATTACK
    counts = rows.filter("cluster <> -1").groupBy("cluster").agg(
        F.sum(F.when(incident, w).otherwise(0)).alias("_p"), F.sum(F.when(incident, 0).otherwise(w)).alias("_q")
    )
    numerator = F.col("_p") * positive_weight
    prior = F.coalesce(F.try_divide(numerator, numerator + F.col("_q") * negative_weight), F.lit(0.0))
    scored = counts.select("cluster", prior.alias("prior"))
    decision = F.when(F.col("prior") >= high, 1).when(F.col("prior") <= low, 0).otherwise(E.CALIBRATED_REJECT)
    noise = rows.filter("cluster = -1").groupBy("cluster").agg(F.lit(0.5).alias("prior"), F.lit(E.CALIBRATED_REJECT).alias("score"))
    return scored.withColumn("score", decision).unionByName(noise)


def scored_vectors(rows: DataFrame, value: str = "score") -> DataFrame:
    """Distinct fingerprints of clustered rows per event with their largest score."""
    return rows.filter("cluster <> -1").groupBy("event_id", "vector").agg(F.max(value).alias(value))


# ---- triage -----------------------------------------------------------------------------------------


def _parts(vectors: DataFrame, size: int) -> DataFrame:
    """Every non-empty set of the features of a narrow fingerprint: `id, event_id, _mass, _fs, _ws` (the features in order, and their weights)."""
    at = [F.get("vector", F.lit(i)) for i in range(size)]
    sets = [[i for i in range(size) if chosen >> i & 1] for chosen in range(1, 1 << size)]
    part = lambda s: F.struct(F.array(*[at[i]["e"] for i in s]).alias("_fs"), F.array(*[at[i]["w"] for i in s]).alias("_ws"))
    made = F.array_compact(F.array(*[F.when(F.size("vector") > s[-1], part(s)) for s in sets]))
    return vectors.select("id", "event_id", mass(F.col("vector")).alias("_mass"), F.inline(made))


def _nearest_by_parts(queries: DataFrame, parts: DataFrame, size: int, reach: int) -> DataFrame:
    """Nearest narrow fingerprint `id, distance, _n` within reach, from what it shares with the query.

    `parts` hold the lightest fingerprint (then the smallest id) that has given weights on a set of features. Taken over the set
    that query and fingerprint have in common this gives their distance, over a smaller set no less: the least is the nearest.
    A query visits each set of its features once per weighting of it, however many fingerprints have that.
    """
    met = _parts(queries, size).join(parts, ["event_id", "_fs"])
    shared = sum((F.coalesce(F.least(F.get("_ws", F.lit(i)), F.get("_stored", F.lit(i))), F.lit(0)) for i in range(size)), F.lit(0))
    offer = F.struct((F.col("_mass") + F.col("_lightest._mass") - 2 * shared).alias("distance"), F.col("_lightest.id").alias("_n"))
    best = met.select("id", offer.alias("_b")).filter(F.col("_b.distance") <= reach).groupBy("id").agg(F.min("_b").alias("_b"))
    return best.select("id", "_b.distance", "_b._n")


#: Radii of the search for a nearest fingerprint, as shares of eps.
_WIDENING = (0.125, 0.25, 0.5, 1.0)


def nearest_scored(queries: DataFrame, stored: DataFrame, eps: float, values: Sequence[str] = ("score",)) -> DataFrame:
    """Nearest stored fingerprint of the same event within eps: `id, distance, values` (absent when none is).

    Ties go to the smallest stored fingerprint. A fingerprint that is stored itself
    is its own nearest, by an equi join. Of narrow fingerprints with few weightings the others
    look up what they may share, without pairs. Else they look around with a widening radius:
    what is found within a radius is the nearest, and only those that have found nothing
    go on, so the pairs of a wide reach are listed for few.
    """
    numbered = cut_lineage(running_position(stored, [], ["event_id", "vector"], "id"))
    own = numbered.select("event_id", "vector", F.col("id").alias("_same"))
    asked = cut_lineage(queries.select("id", "event_id", "vector").join(own, ["event_id", "vector"], "left"))
    found = asked.filter("_same IS NOT NULL").select("id", F.lit(0).alias("distance"), F.col("_same").alias("_n"))
    left = asked.filter("_same IS NULL").drop("_same")
    size, _, _ = _measures(left, numbered)
    radii = _WIDENING
    if 0 < size <= NARROW:
        weighted = _parts(numbered, size).groupBy("event_id", "_fs", F.col("_ws").alias("_stored"))
        parts = cut_lineage(weighted.agg(F.min(F.struct("_mass", "id")).alias("_lightest")))
        if (parts.groupBy("event_id", "_fs").count().agg(F.max("count")).first()[0] or 0) <= WEIGHTINGS:
            found = found.unionByName(cut_lineage(_nearest_by_parts(left, parts, size, int(round(eps * UNIT)))))
            radii = ()
    for share in radii:
        pairs = neighbour_pairs(left, numbered.select("id", "event_id", "vector"), eps * share)
        best = pairs.groupBy(F.col("left_id").alias("id")).agg(F.min(F.struct("distance", "right_id")).alias("_b"))
        best = cut_lineage(best.select("id", "_b.distance", F.col("_b.right_id").alias("_n")))
        found = found.unionByName(best)
        left = cut_lineage(left.join(best.select("id"), "id", "left_anti"))
    found = found.select("id", (F.col("distance") / UNIT).alias("distance"), "_n")
    return found.join(numbered.select(F.col("id").alias("_n"), *values), "_n").drop("_n")


def triage_nearest(patterns: DataFrame, stored: DataFrame, eps: float, threshold: float) -> DataFrame:
    """Code per pattern: -1 low confidence, -2 event never scored, -3 too far, else the nearest score.

    `patterns` has `pattern_id, event_id, vector, confidence`.
    """
    confident = patterns.filter(F.col("confidence") >= threshold)
    distinct = confident.groupBy("event_id", "vector").agg(F.min("pattern_id").alias("id"))
    near = nearest_scored(distinct, stored, eps)
    known = stored.select("event_id").distinct().withColumn("_known", F.lit(True))
    by_vector = distinct.join(near, "id", "left").select("event_id", "vector", "distance", "score")
    joined = patterns.join(by_vector, ["event_id", "vector"], "left").join(known, "event_id", "left")
    code = (
        F.when(F.col("confidence") < threshold, E.NOT_CONFIDENT)
        .when(F.col("_known").isNull(), E.UNSEEN_EVENT)
        .otherwise(F.coalesce("score", F.lit(E.TOO_FAR)))
    )
    return joined.select(*patterns.columns, "distance", code.alias("prediction"))


def triage_calibrated(
    patterns: DataFrame, stored: DataFrame, eps: float, threshold: float, low: float, high: float, scale: float | None = None
) -> DataFrame:
    """As `triage_nearest`, deciding by posterior = prior x confidence x exp(-distance / scale).

    The confidence of a fingerprint is the largest among its patterns; an undecided
    posterior gives -5.
    """
    scale = max(eps if scale is None else scale, 1e-6)
    confident = patterns.filter(F.col("confidence") >= threshold)
    distinct = confident.groupBy("event_id", "vector").agg(
        F.min("pattern_id").alias("id"), F.max("confidence").alias("_confidence")
    )
    near = nearest_scored(distinct, stored, eps, ("prior",))
    known = stored.select("event_id").distinct().withColumn("_known", F.lit(True))
    raw = F.col("prior") * F.col("_confidence") * F.exp(-F.greatest("distance", F.lit(0.0)) / scale)
    # least/greatest skip nulls, so an absent neighbour must be kept apart
    decided = distinct.join(near, "id", "left").withColumn(
        "posterior", F.when(F.col("prior").isNotNull(), clip(raw, 0.0, 1.0))
    )
    verdict = (
        F.when(F.col("posterior").isNull(), E.TOO_FAR)
        .when(F.col("posterior") >= high, 1)
        .when(F.col("posterior") <= low, 0)
        .otherwise(E.CALIBRATED_REJECT)
    )
    by_vector = decided.select("event_id", "vector", "posterior", verdict.alias("_verdict"))
    joined = patterns.join(by_vector, ["event_id", "vector"], "left").join(known, "event_id", "left")
    code = (
        F.when(F.col("confidence") < threshold, E.NOT_CONFIDENT)
        .when(F.col("_known").isNull(), E.UNSEEN_EVENT)
        .otherwise(F.col("_verdict"))
    )
    return joined.select(*patterns.columns, "posterior", code.alias("prediction"))


def matched_workload_rerank(rows: DataFrame, keys: Sequence[str], seed: int, reference: str = "reference", score: str = "score") -> DataFrame:
    """Keep reject codes; the `m` best-scored accepted rows become 1, `m` = the reference's incidents.

    The m-th row is found from counts over (score in ever finer steps, score, seeded
    key), so ties fall independently of row order and no group is sorted in one task.
    """
    accepted = rows.filter(F.col(reference) >= 0)
    slots = rows.groupBy(*keys).agg(F.sum((F.col(reference) > 0).cast("long")).alias("_slots"))
    sized = accepted.join(slots, list(keys)).withColumn("_tie", seeded_key(F.lit(seed), F.col("row_id")))
    levels = [
        # steps of the score itself: a squashed one would put all high scores in one cell
        *[-F.floor(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.col(score))) * step) for step in (1, 1 << 12, 1 << 24)],
        -F.col(score), F.shiftright("_tie", 16), F.col("_tie"), F.col("row_id"),
    ]
    ranked = take_smallest(sized, keys, "_slots", levels)
    decided = ranked.select(*rows.columns, F.col("taken").cast("int").alias("prediction"))
    rejected = rows.filter(F.col(reference) < 0).select(*rows.columns, F.col(reference).cast("int").alias("prediction"))
    return decided.unionByName(rejected)


# ---- linear contextual risk ---------------------------------------------------------------------------


def feature_size(rows: DataFrame, vector: str = "vector") -> int:
    """One more than the largest event id in any fingerprint, so that no event is left without a feature."""
    largest = rows.agg(F.max(F.array_max(F.transform(vector, lambda s: s["e"]))).alias("e")).first()["e"]
    return max(0, -1 if largest is None else largest) + 1


def dense_features(vector: Column, size: int) -> Column:
    """A fingerprint as an array of mass 1; index 0 is the padding feature, index e + 1 event e."""
    lookup = F.map_from_entries(vector)
    return F.transform(
        F.sequence(F.lit(-1), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(lookup, i), F.lit(0)) / F.lit(float(UNIT))
    )


def risk_features(rows: DataFrame, size: int, vector: str = "vector", name: str = "features") -> DataFrame:
    """Fingerprint arrays as MLlib vectors (mass 1), through the built-in array conversion."""
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn(name, array_to_vector(dense_features(F.col(vector), size)))


def fit_risk_model(rows: DataFrame, objective: str, weight_decay: float = 1e-4, weight: str = "weight"):
    """Linear risk: `context_bce` (context only) or `rule_context_bce` (rule log-odds as offset).

    `rows` has `features, label (0/1), weight`, and `rule_logit` for the offset.
    """
    if objective == "context_bce":
        from pyspark.ml.classification import LogisticRegression

        return LogisticRegression(weightCol=weight, regParam=weight_decay, maxIter=50).fit(rows)
    if objective == "rule_context_bce":
        from pyspark.ml.regression import GeneralizedLinearRegression

        return GeneralizedLinearRegression(
            family="binomial", offsetCol="rule_logit", weightCol=weight, regParam=max(weight_decay, 1e-3), maxIter=25
        ).fit(rows)
    raise ValueError(f"unknown objective {objective!r}")


def fit_pairwise_risk(pairs: DataFrame, weight_decay: float = 1e-4):
    """Within-rule ranking: logistic loss on difference vectors, without intercept.

    `pairs` has the positive's and the negative's features as arrays `a` and `b`;
    both signs are given so that both classes occur.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    difference = F.zip_with("a", "b", lambda x, y: x - y)
    plus = pairs.select(array_to_vector(difference).alias("features"), F.lit(1.0).alias("label"))
    minus = pairs.select(array_to_vector(F.transform(difference, lambda x: -x)).alias("features"), F.lit(0.0).alias("label"))
    return LogisticRegression(fitIntercept=False, regParam=weight_decay, maxIter=50).fit(plus.unionByName(minus))


def score_risk(rows: DataFrame, coefficients: Sequence[float], bias: float, rule_logit: str | None = None) -> DataFrame:
    """Linear risk score of a fingerprint; an event the fit never saw weighs nothing, a non-finite score fails the job."""
    weights = F.array(*[F.lit(float(c)) for c in coefficients])
    total = F.aggregate(
        "vector",
        F.lit(float(bias)),
        lambda a, s: a + F.coalesce(F.get(weights, s["e"] + 1), F.lit(0.0)) * s["w"] / F.lit(float(UNIT)),
    )
    if rule_logit:
        total = total + F.col(rule_logit)
    scored = rows.withColumn("score", total)
    bad = F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull()
    return scored.withColumn("score", F.when(bad, F.raise_error(F.lit("non-finite risk score"))).otherwise(F.col("score")))
