"""Target x candidate x recency evidence fitted on training scenarios."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.operators.folds import fold_rows, fold_vocabulary
from alertweave.operators.ordering import running_sums
from alertweave.functions.ratios import clip, ratio_or_null, sigmoid
from alertweave.operators import select as S
from alertweave.operators.select import RECENCY_BANDS, recency_band
from alertweave.session import cut_lineage

GLOBAL_TARGET = -1


def _presences(pool: Column, event, size: Column | int, bands) -> Column:
    """Distinct cells `band * size + event` of a pool: a presence counts once per alert."""
    slots = F.size(pool)
    cells = F.transform(pool, lambda x, i: (recency_band(slots - i, bands) * size + event(x)).cast("int"))
    return F.array_distinct(cells)


def presence_counts(
    pool: DataFrame, label: str, bands: Sequence[tuple[int, int]] = RECENCY_BANDS, weight: str | None = None
) -> DataFrame:
    """Per (scenario, target, band, candidate): alerts of each class with that presence; `weight` is the number of alerts in a row."""
    w = F.lit(1).cast("long") if weight is None else F.col("_weight")
    n = len(bands)
    # event-major here, so that no dictionary size is needed: cell = event * bands + band
    slots = F.size("candidates")
    cells = F.transform(
        "candidates", lambda x, i: (x["event_id"] * n + recency_band(slots - i, bands)).cast("int")
    )
    rows = pool.select(
        "scenario", F.col("event_id").alias("target"), F.col(label).alias("_label"), *([] if weight is None else [F.col(weight).alias("_weight")]),
        F.explode(F.array_distinct(cells)).alias("_cell"),
    )
    counted = rows.groupBy("scenario", "target", "_cell").agg(
        F.sum(F.when(F.col("_label") == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("_label") == 0, w).otherwise(0)).alias("neg"),
    )
    return counted.select(
        "scenario", "target", (F.col("_cell") % n).alias("band"), F.floor(F.col("_cell") / n).cast("int").alias("event"), "pos", "neg"
    )


def _weight(pos: Column, neg: Column, n_pos: Column, n_neg: Column, alpha: float, limit: float) -> Column:
    def logit(count: Column, total: Column) -> Column:
        p = (count + alpha) / (total + 2.0 * alpha)
        return F.ln(p) - F.log1p(-p)

    return clip(logit(pos, n_pos) - logit(neg, n_neg), -limit, limit)


def _absence(pos: Column, neg: Column, n_pos: Column, n_neg: Column, alpha: float) -> Column:
    def log_absent(count: Column, total: Column) -> Column:
        return F.log1p(-(count + alpha) / (total + 2.0 * alpha))

    return log_absent(pos, n_pos) - log_absent(neg, n_neg)


def fit_association(
    pool: DataFrame,
    alerts: DataFrame,
    folds: DataFrame,
    label: str = "event_incident",
    bands: Sequence[tuple[int, int]] = RECENCY_BANDS,
    alpha: float = 1.0,
    limit: float = 6.0,
    weight: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """`(cells, targets)` per fold in sparse form.

    `cells(test_scenario, target, band, event, weight)` has the observed cells;
    `targets(test_scenario, target, base, default_weight, vocabulary)` gives each
    target's base log-odds and the weight of a cell never observed. Targets that
    lack a class use the pooled table, stored under target -1. Contexts stay
    inside a scenario, so counts per scenario add up to counts per fold. Both count
    tables are bounded by the dictionary, are read several times, and are fixed
    when made, so the candidate pool is built once. Rows of the pool may stand for
    several alerts: `weight` is their number.
    """
    totals = alerts.groupBy("scenario", F.col("event_id").alias("target")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n_neg"),
    )
    per_target = cut_lineage(
        fold_rows(totals, folds, ["train"])
        .groupBy("test_scenario", "target")
        .agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    )
    observed = cut_lineage(
        fold_rows(presence_counts(pool, label, bands, weight), folds, ["train"])
        .groupBy("test_scenario", "target", "band", "event")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    pooled_totals = per_target.groupBy("test_scenario").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), (F.count("*") + 1).alias("vocabulary")
    )
    pooled = observed.groupBy("test_scenario", "band", "event").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    supported = per_target.filter("n_pos > 0 AND n_neg > 0").join(
        pooled_totals.select("test_scenario", "vocabulary"), "test_scenario"
    )
    everyone = supported.unionByName(pooled_totals.withColumn("target", F.lit(GLOBAL_TARGET)))
    counted = observed.unionByName(pooled.withColumn("target", F.lit(GLOBAL_TARGET))).join(
        everyone, ["test_scenario", "target"]
    )
    args = (F.col("pos"), F.col("neg"), F.col("n_pos"), F.col("n_neg"), alpha)
    cells = counted.select("test_scenario", "target", "band", "event", _weight(*args, limit).alias("weight"))

    zero = (F.lit(0), F.lit(0), F.col("n_pos"), F.col("n_neg"), alpha)
    evidence = counted.groupBy("test_scenario", "target").agg(
        F.sum(_absence(*args)).alias("_absent"), F.count("*").alias("_cells")
    )
    unseen = F.col("vocabulary") * len(bands) - F.coalesce("_cells", F.lit(0))
    base = (
        F.ln(F.col("n_pos") + alpha)
        - F.ln(F.col("n_neg") + alpha)
        + F.coalesce("_absent", F.lit(0.0))
        + unseen * _absence(*zero)
    )
    targets = everyone.join(evidence, ["test_scenario", "target"], "left").select(
        "test_scenario", "target", base.alias("base"), _weight(*zero, limit).alias("default_weight"), "vocabulary"
    )
    return cells, targets


def association_model(
    pool: DataFrame, alerts: DataFrame, folds: DataFrame, label: str = "event_incident",
    bands: Sequence[tuple[int, int]] = RECENCY_BANDS, decimals: int | None = None, **fit,
) -> DataFrame:
    """The fitted tables as one row per (fold, event): arrays addressed by position.

    Weights are kept as fitted; `decimals` rounds them, for comparisons with
    another engine whose last digits differ.

    `weights` is band-major over local events, `local_of` maps a global event id to
    its local id (unknown = vocabulary - 1). Rows are as many as folds times event
    types, so slots are scored by array lookup without exploding them.
    """
    cells, targets = fit_association(pool, alerts, folds, label, bands, **fit)
    exact = lambda w: w if decimals is None else F.round(w, decimals)
    per_event = alerts.groupBy("scenario", "event_id").agg(F.count("*").alias("_n"))
    vocabulary = fold_vocabulary(per_event, folds)
    dictionary = vocabulary.groupBy("test_scenario").agg(
        F.map_from_entries(F.collect_list(F.struct("event_id", "local_id"))).alias("_dict"),
        F.max("size").alias("_unknown"),
    )
    events = per_event.select("event_id").distinct()
    span = events.agg(F.max("event_id").alias("_last")).withColumn("_one", F.lit(1))
    arrays = dictionary.withColumn("_one", F.lit(1)).join(span, "_one").select(
        "test_scenario",
        F.transform(
            F.sequence(F.lit(0), F.col("_last")), lambda e: F.coalesce(F.try_element_at("_dict", e), F.col("_unknown"))
        ).alias("local_of"),
    )
    local = cells.join(
        vocabulary.select("test_scenario", F.col("event_id").alias("event"), "local_id", "size"), ["test_scenario", "event"]
    )
    cell_maps = local.groupBy("test_scenario", "target").agg(
        F.map_from_entries(
            F.collect_list(F.struct((F.col("band") * (F.col("size") + 1) + F.col("local_id")).alias("cell"), "weight"))
        ).alias("_cells")
    )
    dense = targets.join(cell_maps, ["test_scenario", "target"], "left").select(
        "test_scenario",
        "target",
        "base",
        "vocabulary",
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("vocabulary") * len(bands) - 1),
            lambda c: exact(F.coalesce(F.try_element_at("_cells", c), F.col("default_weight"))),
        ).alias("weights"),
    )
    wanted = arrays.join(events.withColumn("_one", F.lit(1)), F.col("_one") == 1).drop("_one")
    own = wanted.join(dense.withColumnRenamed("target", "event_id"), ["test_scenario", "event_id"], "left")
    pooled = dense.filter(F.col("target") == GLOBAL_TARGET).select(
        "test_scenario",
        F.col("base").alias("_b"),
        F.col("weights").alias("_w"),
        F.col("vocabulary").alias("_v"),
    )
    model = own.join(pooled, "test_scenario").select(
        "test_scenario",
        "event_id",
        F.coalesce("base", "_b").alias("base"),
        F.coalesce("weights", "_w").alias("weights"),
        F.coalesce("vocabulary", "_v").alias("vocabulary"),
        "local_of",
    )
    return cut_lineage(model)


def local_event(slot: Column) -> Column:
    return F.element_at(F.col("local_of"), slot["event_id"] + 1)


#: A fitted table of at most so many bytes is shipped to the alerts; a larger one meets them by a join on salted keys.
SHIPPED_BYTES = 64 << 20
#: Parts of a (fold, target) key in that join.
SALTS = 64


def model_bytes(model: DataFrame) -> int:
    """Measured size of a fitted table: its weights, its addresses and a row's own fields."""
    width = F.size("weights") * 8 + F.size("local_of") * 4 + 64
    return model.agg(F.sum(width.cast("long")).alias("b")).first()["b"] or 0


def with_model(
    pool: DataFrame, folds: DataFrame, model: DataFrame, roles: Sequence[str] = ("test",), shipped_bytes: int = SHIPPED_BYTES
) -> DataFrame:
    """Every alert of the given roles with its fold's model row for its target.

    The candidate pool is the large side and stays where it is as long as the model, met
    with the folds first, is within `shipped_bytes`: its rows are folds times event types. Beyond it the
    few (scenario, target) keys are salted, so a frequent event type fills no task.
    """
    fitted = model.join(folds.filter(F.col("role").isin(*roles)), "test_scenario")
    if model_bytes(fitted) <= shipped_bytes:
        return pool.join(F.broadcast(fitted), ["scenario", "event_id"])
    salted = pool.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    copies = fitted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), ["scenario", "event_id", "_salt"]).drop("_salt")


SELECTORS: dict[str, Callable[..., Column]] = {
    "association_abs": lambda k, anchors: S.association_abs(F.col("candidates"), k, F.col("weights"), F.col("vocabulary"), local_event),
    "class_oracle": lambda k, anchors: S.class_oracle(
        F.col("candidates"), k, F.col("weights"), F.col("vocabulary"), local_event, F.col("event_incident")
    ),
    "anchored_association": lambda k, anchors: S.anchored_association(
        F.col("candidates"), k, anchors, F.col("weights"), F.col("vocabulary"), local_event
    ),
}


def select_slots(
    rows: DataFrame, k: int = 10, anchors: int = 5, selectors: Sequence[str] = tuple(SELECTORS), keys: Sequence[str] = ("row_id",)
) -> DataFrame:
    """`test_scenario, <keys>, selector, slots`: the chosen slots of every alert for each selector, in one pass over the pool.

    `rows` come from `with_model`; the score of a selector is worked out where the pool lies, so nothing is shuffled.
    """
    chosen = [F.struct(F.lit(name).alias("selector"), SELECTORS[name](k, anchors).alias("slots")) for name in selectors]
    return rows.select("test_scenario", *keys, F.inline(F.array(*chosen)))


def write_selected(selected: DataFrame, path: str) -> None:
    """The slots of each selector and fold as a table of its own partition."""
    selected.write.mode("overwrite").partitionBy("selector", "test_scenario").parquet(path)


def association_score(bands: Sequence[tuple[int, int]] = RECENCY_BANDS) -> Column:
    """Base log-odds plus the weights of the pool's distinct presences (needs `with_model`)."""
    present = _presences(F.col("candidates"), local_event, F.col("vocabulary"), bands)
    return F.aggregate(present, F.col("base"), lambda acc, cell: acc + F.element_at(F.col("weights"), cell + 1))


def probability_metrics(rows: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Rows, prevalence, ROC-AUC, average precision, log loss and Brier score of sigmoid(score).

    Ranks come from running sums over the distinct probabilities, so neither a hot
    score nor a large group has to be sorted in one task.
    """
    p = sigmoid(F.col(score))
    scored = rows.select(*keys, F.col(label).cast("int").alias("_y"), p.alias("_p"))
    counts = scored.groupBy(*keys, "_p").agg(
        F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg")
    ).withColumn("_down", -F.col("_p"))
    ranked = running_sums(counts, keys, ["_down"], {"_pos_above": F.col("_pos"), "_neg_above": F.col("_neg")})
    tiny = F.lit(2.220446049250313e-16)
    bounded = F.least(F.greatest(F.col("_p"), tiny), 1 - tiny)
    pos, neg = F.col("_pos"), F.col("_neg")
    precision_here = (F.col("_pos_above") + pos) / (F.col("_pos_above") + pos + F.col("_neg_above") + neg)
    sums = ranked.groupBy(*keys).agg(
        F.sum("_pos").alias("_P"),
        F.sum("_neg").alias("_N"),
        F.sum(neg * (F.col("_pos_above") + pos / 2.0)).alias("_wins"),
        F.sum(pos * precision_here).alias("_steps"),
        F.sum(-(pos * F.ln(bounded) + neg * F.log1p(-bounded))).alias("_loss"),
        F.sum(pos * F.pow(1 - F.col("_p"), 2) + neg * F.pow(F.col("_p"), 2)).alias("_brier"),
    )
    n = F.col("_P") + F.col("_N")
    return sums.select(
        *keys,
        n.alias("rows"),
        (F.col("_P") / n).alias("prevalence"),
        ratio_or_null(F.col("_wins"), F.col("_P") * F.col("_N")).alias("roc_auc"),
        ratio_or_null(F.col("_steps"), F.col("_P")).alias("average_precision"),
        (F.col("_loss") / n).alias("log_loss"),
        (F.col("_brier") / n).alias("brier_score"),
    )
