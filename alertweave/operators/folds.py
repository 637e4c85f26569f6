"""Scenario folds, label reveal and samplers.

Random choices come from `md5(seed | key)`, so a sample depends on the row's key
and not on partitioning, and another engine can reproduce it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions.hashing import hex_mod10, seeded_key, split_code
from alertweave.operators.ordering import first_rows, running_position, whole_cut


def scenario_folds(rows: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """`test_scenario, scenario, role`: the next scenario in order validates, the rest train.

    `order` fixes the scenario order; by default they are taken sorted.
    """
    if order is not None:
        if len(order) < 3:
            raise ValueError("at least three scenarios are needed")
        names = rows.select(F.array(*[F.lit(s) for s in order]).alias("names")).limit(1)
    else:
        names = rows.agg(F.sort_array(F.collect_set("scenario")).alias("names"))
    n = F.size("names")
    tests = names.filter(n >= 3).select("names", F.posexplode("names").alias("t", "test_scenario"))
    pairs = tests.select("t", "test_scenario", n.alias("n"), F.posexplode("names").alias("s", "scenario"))
    role = (
        F.when(F.col("s") == F.col("t"), "test")
        .when(F.col("s") == (F.col("t") + 1) % F.col("n"), "validation")
        .otherwise("train")
    )
    return pairs.select("test_scenario", "scenario", role.alias("role"))


def fold_rows(rows: DataFrame, folds: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Rows repeated per fold in which their scenario plays one of `roles`."""
    return rows.join(folds.filter(F.col("role").isin(*roles)), "scenario")


def fold_vocabulary(counts: DataFrame, folds: DataFrame, key: str = "event_id") -> DataFrame:
    """Per fold, events seen in training scenarios with dense local ids by event id, and the vocabulary size.

    Unknown = size, pad = size + 1. `counts` holds one row per (scenario, key).
    """
    seen = fold_rows(counts.select("scenario", key).distinct(), folds, ["train"]).select("test_scenario", key).distinct()
    by_fold = Window.partitionBy("test_scenario")
    return seen.select(
        "test_scenario",
        key,
        (F.row_number().over(by_fold.orderBy(key)) - 1).alias("local_id"),
        F.count("*").over(by_fold).alias("size"),
    )


def vocabulary_maps(vocabulary: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per fold: the dictionary as a map, and its size. For dictionaries of event types."""
    return vocabulary.groupBy("test_scenario").agg(
        F.map_from_entries(F.collect_list(F.struct(key, "local_id"))).alias("dictionary"),
        F.max("size").alias("size"),
    )


def encode_array(values: Column, dictionary: Column, size: Column) -> Column:
    """Local ids of an array of event ids; unseen events become `size` (unknown)."""
    return F.transform(values, lambda v: F.coalesce(F.try_element_at(dictionary, v), size).cast("int"))


def reveal_labels(
    rows: DataFrame,
    folds: DataFrame,
    budget: int,
    ratio: int,
    seeds: Sequence[int],
    label: str = "event_incident",
    group: str = "event_incident_group",
) -> DataFrame:
    """Per (test_scenario, seed): an exact-ratio label budget from the training scenarios.

    Positives cycle over incident groups (rank inside the group = round), negatives
    are uniform. Candidates are cut per scenario or group first, so the per-fold
    ranking only sees a few budgets' worth of rows.
    """
    if budget <= 1 or ratio < 1:
        raise ValueError("budget must exceed 1 and ratio be at least 1")
    positives_wanted = max(1, budget // (ratio + 1))
    negatives_wanted = min(budget - positives_wanted, positives_wanted * ratio)
    keyed = rows.select(
        "scenario", "row_id", label, F.col(group).alias("_group"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"), *[c for c in rows.columns if c not in ("scenario", "row_id", label, group)]
    ).withColumn("_key", seeded_key(F.col("seed"), F.col("row_id")))
    order = [F.col("_key"), F.col("row_id")]
    levels = [F.shiftright("_key", 16), F.col("_key"), F.col("row_id")]

    positives = first_rows(keyed.filter(F.col(label) == 1), ["seed", "scenario", "_group"], order, levels, positives_wanted)
    rounds = Window.partitionBy("seed", "scenario", "_group").orderBy(*order)
    positives = positives.withColumn("_round", F.row_number().over(rounds))
    positives = positives.withColumn("_turn", seeded_key(F.col("seed"), F.col("_round"), F.col("_group")))
    negatives = first_rows(keyed.filter(F.col(label) == 0), ["seed", "scenario"], order, levels, negatives_wanted)

    def per_fold(part: DataFrame, by: list[Column], want: int) -> DataFrame:
        spread = fold_rows(part, folds, ["train"])
        rank = F.row_number().over(Window.partitionBy("test_scenario", "seed").orderBy(*by))
        return spread.withColumn("_rank", rank).filter(F.col("_rank") <= want)

    columns = ["test_scenario", "seed", *rows.columns]
    chosen_positives = per_fold(positives, [F.col("_round"), F.col("_turn"), F.col("row_id")], positives_wanted)
    chosen_negatives = per_fold(negatives, order, negatives_wanted)
    chosen = chosen_positives.select(*[F.col("_group").alias(group) if c == group else F.col(c) for c in columns])
    return chosen.unionByName(
        chosen_negatives.select(*[F.col("_group").alias(group) if c == group else F.col(c) for c in columns])
    )


def uniform_sample(rows: DataFrame, size: int, seed: int, key: str = "row_id") -> DataFrame:
    """`size` rows without replacement by seeded key; cycles through the ranking when there are fewer rows.

    Output has one row per draw (`draw`, 0-based).
    """
    keyed = rows.withColumn("_key", seeded_key(F.lit(seed), F.col(key)))
    picked = first_rows(
        keyed, [], [F.col("_key"), F.col(key)], [F.shiftright("_key", 16), F.col("_key"), F.col(key)], size
    )
    # at most `size` rows are left for the ranking
    ranked = picked.withColumn("_rank", F.row_number().over(Window.orderBy("_key", key)) - 1)
    ranked = ranked.withColumn("_total", F.count("*").over(Window.partitionBy()))
    rounds = F.sequence(F.lit(0), F.floor((F.lit(size - 1) - F.col("_rank")) / F.col("_total")).cast("int"))
    return ranked.withColumn("_round", F.explode(rounds)).select(
        *rows.columns, (F.col("_round") * F.col("_total") + F.col("_rank")).alias("draw")
    )


def _draws(spark, size: int, seed: int, salt: str) -> DataFrame:
    return spark.range(size).select(
        F.col("id").alias("draw"), seeded_key(F.lit(seed), F.lit(salt), F.col("id")).alias("_u")
    )


def _ranked(rows: DataFrame, keys: Sequence[str], seed: int, name: str) -> DataFrame:
    keyed = rows.withColumn("_key", seeded_key(F.lit(seed), F.col("row_id")))
    return running_position(keyed, keys, ["_key", "row_id"], name).drop("_key")


def group_balanced_sample(rows: DataFrame, size: int, seed: int, label: str = "label", group: str = "group") -> DataFrame:
    """`draw, row_id, label`: half positives (group uniform, then row uniform), half negatives, with replacement.

    Every draw picks a group by hash modulo the number of groups, then a member by
    hash modulo the group size; members are looked up by position.
    """
    spark = rows.sparkSession
    half = size // 2
    positives = _ranked(rows.filter(F.col(label) == 1).withColumn("_g", F.col(group)), ["_g"], seed, "_pos")
    sizes = positives.groupBy("_g").agg(F.count("*").alias("_n"))
    indexed = sizes.withColumn("_gi", F.row_number().over(Window.orderBy("_g")) - 1)
    indexed = indexed.withColumn("_groups", F.count("*").over(Window.partitionBy()))
    groups = indexed.agg(F.max("_groups").alias("_groups")).withColumn("_one", F.lit(1))
    drawn = _draws(spark, half, seed, "group").withColumn("_one", F.lit(1)).join(groups, "_one")
    drawn = drawn.withColumn("_gi", F.col("_u") % F.col("_groups")).join(indexed.drop("_groups"), "_gi")
    member = seeded_key(F.lit(seed), F.lit("member"), F.col("draw"))
    drawn = drawn.withColumn("_pos", member % F.col("_n"))
    chosen = drawn.join(positives, ["_g", "_pos"]).select("draw", "row_id", label)

    negatives = _ranked(rows.filter(F.col(label) == 0).withColumn("_g", F.lit("-")), ["_g"], seed, "_pos")
    total = negatives.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    # without replacement while there are enough negatives: the draw number is the position
    other = spark.range(half, size).select(F.col("id").alias("draw"), F.lit(1).alias("_one")).join(total, "_one")
    other = other.withColumn("_pos", (F.col("draw") - half) % F.col("_n"))
    return chosen.unionByName(other.join(negatives, "_pos").select("draw", "row_id", label))


def same_rule_pair_sample(
    rows: DataFrame, size: int, seed: int, label: str = "label", group: str = "group", rule: str = "event_id"
) -> DataFrame:
    """`draw, rule, positive, negative`: group-uniform positives, each with a random negative of its rule."""
    spark = rows.sparkSession
    negatives = _ranked(rows.filter(F.col(label) == 0).select("row_id", rule), [rule], seed, "_pos")
    per_rule = negatives.groupBy(rule).agg(F.count("*").alias("_negatives"))
    eligible = rows.filter(F.col(label) == 1).join(per_rule.select(rule), rule, "left_semi")
    positives = _ranked(eligible.withColumn("_g", F.col(group)), ["_g"], seed, "_pos")
    sizes = positives.groupBy("_g").agg(F.count("*").alias("_n"))
    indexed = sizes.withColumn("_gi", F.row_number().over(Window.orderBy("_g")) - 1)
    groups = indexed.agg(F.count("*").alias("_groups")).withColumn("_one", F.lit(1))
    drawn = _draws(spark, size, seed, "group").withColumn("_one", F.lit(1)).join(groups, "_one")
    drawn = drawn.withColumn("_gi", F.col("_u") % F.col("_groups")).join(indexed, "_gi")
    drawn = drawn.withColumn("_pos", seeded_key(F.lit(seed), F.lit("member"), F.col("draw")) % F.col("_n"))
    chosen = drawn.join(positives, ["_g", "_pos"]).select("draw", rule, F.col("row_id").alias("positive"))
    chosen = chosen.join(per_rule, rule)
    chosen = chosen.withColumn("_pos", seeded_key(F.lit(seed), F.lit("partner"), F.col("draw")) % F.col("_negatives"))
    return chosen.join(negatives, [rule, "_pos"]).select("draw", rule, "positive", F.col("row_id").alias("negative"))


def ratio_split(rows: DataFrame, ratio: float, order: Sequence[Column], name: str = "split") -> DataFrame:
    """`train` for the first `min(max(1, int(n * ratio)), n - 1)` rows by `order`, else `test`.

    The cut row is found from counts per order level, never by sorting the table, and compared with
    each row as a constant, so that no row is moved.
    """
    want = lambda n: F.least(F.greatest(F.lit(1), F.floor(n * F.lit(float(ratio)))), n - 1)
    cut = whole_cut(rows, want, order)
    if cut is None:
        return rows.withColumn(name, F.lit("test"))
    position = F.struct(*[c.alias(f"_lv{i}") for i, c in enumerate(order)])
    return rows.withColumn(name, F.when(position <= cut, "train").otherwise("test"))


def sequence_split(lines: DataFrame, training_source: str = "train") -> DataFrame:
    """Duplicate-safe split by content hash: identical lines always share a split."""
    # staged, so that each line is hashed once
    digest = lines.withColumn("_digest", F.sha2(F.regexp_replace("line", "[\r\n]+$", ""), 256))
    bucketed = digest.withColumn("_bucket", hex_mod10(F.col("_digest")))
    return bucketed.withColumn("split", split_code(F.col("source"), F.col("_bucket"), training_source)).withColumnRenamed(
        "_digest", "pattern"
    ).drop("_bucket")


def blind_labels(lines: DataFrame, final_split: int = 3, label: str = "label") -> DataFrame:
    return lines.withColumn(label, F.when(F.col("split") == final_split, -9).otherwise(F.col(label)))
