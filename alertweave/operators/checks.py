"""Data-quality and invariant checks, as queries that return violations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_differences(df: DataFrame, expected: Iterable[str], exact: bool = True) -> list[str]:
    """Columns that are missing (`-name`) or, when `exact`, unexpected (`+name`)."""
    have, want = set(df.columns), set(expected)
    return sorted([f"-{c}" for c in want - have] + ([f"+{c}" for c in have - want] if exact else []))


def column_violations(df: DataFrame, expected: DataFrame, exact: bool = True) -> DataFrame:
    """`column, problem, filled`: columns that are missing, of another type or, when `exact`, unexpected, with the rows that fill them.

    The schema is a relation: `expected` has `column, type`. The rows are read once.
    """
    spark = df.sparkSession
    types = spark.createDataFrame(df.dtypes, "column string, actual string")
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    filled = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("filled")) for c in df.columns])))
    joined = types.join(filled, "column").join(expected.select("column", "type"), "column", "full")
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("type").isNull(), "unexpected").when(F.col("type") != F.col("actual"), "type")
    found = joined.select("column", problem.alias("problem"), F.coalesce("filled", F.lit(0)).cast("long").alias("filled")).filter("problem IS NOT NULL")
    return found if exact else found.filter("problem <> 'unexpected'")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or df.columns)
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in names])
    return counts.select(F.inline(pairs))


def row_count_differences(rows: DataFrame, expected: DataFrame, key: str = "scenario") -> DataFrame:
    """Expected against actual rows per key and in total (`__all__`); only differences."""
    actual = rows.groupBy(key).agg(F.count("*").alias("actual"))
    joined = expected.join(actual, key, "left").na.fill(0, ["actual"])
    totals = joined.rollup(key).agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
    return totals.withColumn(key, F.coalesce(key, F.lit("__all__"))).filter("expected <> actual")


def violation_counts(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """`check, violations` in one pass; a null test counts as a violation."""
    counts = rows.agg(*[F.sum((~F.coalesce(ok, F.lit(False))).cast("long")).alias(n) for n, ok in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(n, F.lit(0)).alias("violations")) for n in checks])
    return counts.select(F.inline(pairs))


def row_id_density(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Extremes, duplicates and whether ids are exactly 0..n-1."""
    per_id = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return per_id.agg(
        F.min(key).alias("lowest"), F.max(key).alias("highest"), F.sum("_n").alias("rows"), F.count("*").alias("ids")
    ).withColumn("dense", (F.col("lowest") == 0) & (F.col("highest") == F.col("rows") - 1) & (F.col("ids") == F.col("rows")))


def ids_outside(rows: DataFrame, column: str, vocabulary: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not in the vocabulary."""
    return rows.join(vocabulary.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def fold_overlaps(folds: DataFrame) -> DataFrame:
    """Scenarios with more than one role in a fold."""
    return folds.groupBy("test_scenario", "scenario").agg(F.countDistinct("role").alias("roles")).filter("roles > 1")


# fixed values: names of the rates that a record carries, as the metric families name them
_RATES = (
    "analyst_workload", "triage_incident_recall", "reject_rate", "automation_coverage", "relaxed_f1", "incident_group_recall",
)
_CLOSE = 1e-8


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= _CLOSE


def metric_violations(records: DataFrame, keys: Sequence[str], expected_rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per broken metric invariant of a record (`keys`, violation).

    `expected_rows` gives the size of each split by `on` (column `split_rows`).
    """
    c = F.col
    joined = records.join(expected_rows, list(on), "left")
    precision = c("triage_precision")
    rules: dict[str, Column] = {
        **{f"invalid {r}": c(r).isNotNull() & ~F.isnan(r) & c(r).between(0, 1) for r in _RATES},
        "alert count differs from the split": c("alerts").eqNullSafe(c("split_rows")),
        "undefined precision at nonzero workload": precision.isNotNull() | _near(c("analyst_workload"), F.lit(0.0)),
        "invalid triage_precision": precision.isNull() | precision.between(0, 1),
        "coverage + reject <> 1": _near(c("automation_coverage") + c("reject_rate"), F.lit(1.0)),
        "reject exceeds workload": c("reject_rate") <= c("analyst_workload") + 1e-12,
        "workload <> reject + automatic": _near(c("analyst_workload"), c("reject_rate") + c("auto_incident_rate")),
        "reject <> sum of codes": _near(
            c("reject_rate"),
            c("reject_low_confidence_rate") + c("reject_unknown_event_rate") + c("reject_distance_rate"),
        ),
    }
    broken = F.filter(
        F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]),
        lambda x: x.isNotNull(),
    )
    return joined.select(*keys, F.explode(broken).alias("violation"))


def missing_runs(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combinations of the values seen for `keys` that have no record (panel completeness)."""
    sets = records.agg(*[F.collect_set(k).alias(k) for k in keys])
    panel = sets
    for k in keys:
        panel = panel.withColumn(k, F.explode(k))
    return panel.join(records.select(*keys).distinct(), list(keys), "left_anti")


def duplicate_runs(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count("*").alias("records")).filter("records > 1")


def unequal_splits(records: DataFrame, group: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Groups of paired runs that were not evaluated on the same split."""
    return records.groupBy(*group).agg(F.countDistinct(F.struct(*identity)).alias("variants")).filter("variants > 1")


def reproduction(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Metric-by-metric comparison of two record sets: rows compared, missing, differing and the largest gap."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])
        return df.select(*keys, F.inline(pairs))
    joined = long(ours, "a").join(long(theirs, "b"), [*keys, "metric"], "full")
    gap = F.abs(F.col("a") - F.col("b"))
    return joined.groupBy("metric").agg(
        F.count("*").alias("compared"),
        F.sum((F.col("a").isNull() != F.col("b").isNull()).cast("long")).alias("one_sided"),
        F.sum((gap > tolerance).cast("long")).alias("different"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("largest_gap"),
    )


def matched_violations(pairs: DataFrame, keys: Sequence[str], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs whose columns should agree and do not."""
    bad = None
    for a, b in columns:
        test = ~F.col(a).eqNullSafe(F.col(b))
        bad = test if bad is None else bad | test
    return pairs.filter(bad).select(*keys, *[c for pair in columns for c in pair])


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint that any SQL engine can reproduce: rows, xor and sum of 60 bits of each row's md5.

    A row is its values as text in column-name order, each after its length, so that no two rows read alike.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]
    digest = F.md5(F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]))
    row_hash = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return df.select(row_hash.alias("_h")).agg(
        F.count("*").alias("rows"),
        F.bit_xor("_h").alias("hash_xor"),
        F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )


def fingerprint_matches(df: DataFrame, recorded: dict) -> DataFrame:
    current = table_fingerprint(df)
    ok = None
    for name, value in recorded.items():
        test = F.col(name).eqNullSafe(F.lit(value))
        ok = test if ok is None else ok & test
    return current.withColumn("unchanged", ok)
