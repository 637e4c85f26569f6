"""End-to-end contextual triage with interchangeable parts.

alerts -> context -> split -> patterns -> fingerprints -> confidence -> clusters ->
scores -> triage of the held-out rows. Expensive steps run on distinct patterns and
results are joined back to rows at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.operators import context as C
from alertweave.operators import triage as T
from alertweave.operators.folds import ratio_split
from alertweave.session import cut_lineage, stored_rows


@dataclass(frozen=True)
class TriageSetup:
    width: int = 10
    timeout: int = 86_400
    train_ratio: float = 0.2
    scheme: str = "recency"
    eps: float = 0.10
    min_samples: int = 5
    threshold: float = 0.2
    strategy: str = "max"

    @property
    def bands(self) -> tuple[tuple[int, int], ...]:
        return tuple((r, r) for r in range(1, self.width + 1))


def _strict(alerts: DataFrame, setup: TriageSetup) -> DataFrame:
    return C.strict_past_context(alerts, setup.width, setup.timeout).withColumn("context", C.ids("context"))


def _strict_seconds(alerts: DataFrame, setup: TriageSetup, alike: DataFrame) -> DataFrame:
    """`alike` rows, counted per second of a machine, with the strict context of their second."""
    seconds = C.strict_past_seconds(alerts, setup.width, setup.timeout)
    return alike.join(seconds, ["machine", "timestamp"]).withColumn("context", C.ids("context"))


def _arrival(alerts: DataFrame, setup: TriageSetup) -> DataFrame:
    return C.arrival_context(alerts, setup.width).withColumn("context", C.ids("context"))


def _cross_machine(alerts: DataFrame, setup: TriageSetup) -> DataFrame:
    """Own-machine slots followed by companion slots, half the width each."""
    local = setup.width - setup.width // 2
    own = C.strict_past_context(alerts, local, setup.timeout)
    both = C.companion_context(own, setup.width - local)
    pad = F.lit(-1)
    joined = F.concat(C.left_pad(C.ids("context"), local, pad), C.left_pad(C.ids("companions"), setup.width - local, pad))
    return both.withColumn("context", joined).drop("companions")


def _short_long(alerts: DataFrame, setup: TriageSetup) -> DataFrame:
    long = setup.width // 2
    rows = C.short_long_context(alerts, setup.width - long, long)
    pad = F.lit(-1)
    joined = F.concat(C.left_pad(F.col("long_memory"), long, pad), C.left_pad(F.col("short_context"), setup.width - long, pad))
    return rows.withColumn("context", joined).drop("long_memory", "short_context")


CONTEXTS = {"strict": _strict, "arrival": _arrival, "cross_machine": _cross_machine, "short_long": _short_long}


def split_patterns(alerts: DataFrame, setup: TriageSetup, context: str = "strict") -> DataFrame:
    """Distinct (split, target, context) with counts, label and padded context; `pattern_id` numbers them.

    `alerts` has `label` (attack id, -1 = none).
    """
    order = [F.floor(F.col("timestamp") / 86_400), F.col("timestamp"), F.floor(F.col("row_id") / 65_536), F.col("row_id")]
    columns = ["scenario", "machine", "timestamp", "row_id", "event_id", "label"]
    rows = ratio_split(stored_rows(alerts.select(*columns)), setup.train_ratio, order)
    if context == "strict":
        # alike rows of a second share its context: they are counted before they meet it
        alike = rows.groupBy("machine", "timestamp", "split", "event_id").agg(F.count("*").alias("_rows"), F.max("label").alias("label"))
        rows = _strict_seconds(rows, setup, alike)
        patterns = T.compact_patterns(rows, setup.min_samples, keys=["split"], count="_rows")
    else:
        patterns = T.compact_patterns(CONTEXTS[context](rows, setup), setup.min_samples, keys=["split"])
    padded = C.left_pad(F.col("context"), setup.width, -1)
    numbered = T.running_position(patterns, [], ["split", "event_id", "context"], "pattern_id")
    return numbered.withColumn("padded", padded)


def with_confidence(patterns: DataFrame, setup: TriageSetup) -> DataFrame:
    """Fingerprint and next-event confidence of every pattern, fitted on the training split."""
    weights = T.slot_weights(setup.width, setup.scheme)
    train = patterns.filter("split = 'train'")
    pairs, slots = T.next_event_counts(train, setup.bands)
    size = train.agg((F.countDistinct("event_id") + 1).alias("size"))
    confident = T.next_event_confidence(patterns, pairs, slots, size, weights, setup.bands)
    return confident.withColumn("vector", T.fingerprint(F.col("padded"), weights))


def cluster_patterns(patterns: DataFrame, setup: TriageSetup) -> DataFrame:
    """Training patterns that pass the confidence gate, with their cluster."""
    train = patterns.filter((F.col("split") == "train") & (F.col("confidence") >= setup.threshold))
    vectors = T.numbered_vectors(train)
    clusters = T.density_cluster(vectors, setup.eps, setup.min_samples)
    named = vectors.join(clusters.select("id", "core", "cluster"), "id").select("event_id", "vector", "core", "cluster")
    return train.join(named, ["event_id", "vector"])


def fit(patterns: DataFrame, setup: TriageSetup) -> DataFrame:
    """Scored fingerprints of the training split."""
    clustered = cut_lineage(cluster_patterns(patterns, setup))
    scores = T.score_clusters(clustered, setup.strategy)
    return T.scored_vectors(T.with_cluster_score(clustered, scores))


def run(alerts: DataFrame, setup: TriageSetup | None = None, context: str = "strict") -> DataFrame:
    """Predictions for every held-out pattern, with counts and labels."""
    setup = setup or TriageSetup()
    patterns = cut_lineage(with_confidence(split_patterns(alerts, setup, context), setup))
    stored = cut_lineage(fit(patterns, setup))
    return T.triage_nearest(patterns.filter("split = 'test'"), stored, setup.eps, setup.threshold)
