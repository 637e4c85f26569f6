"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only).

Each document gets five measures. Their quantiles are sketched (KLL) per
language and source; the sketches of a language merge into one for the
language, and all merge into one. A measure may lie so many half spreads from
the median of its own group; groups with few documents use the thresholds of
their language, few of those the overall ones. The thresholds are then joined to
the documents on (lang, source).

Defined cases: a null text has no words and fails the base rules; null
language or source is a group of its own; doc_id may be null or repeated, as
no step joins on it; an empty table gives an empty result. Columns that the
result names replace columns of the input with the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import SPACES, let, stored, words_of
from alertweave.session import cut_lineage

_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """Distance from the median, in half spreads of at least `floor`, beyond which a measure is rejected."""

    measure: str
    reach: float
    floor: float
    below: bool = False


FENCES = (
    Fence("symbol_share", 3.0, 0.015),
    Fence("repeat_share", 4.0, 0.1),
    Fence("dup_line_share", 4.0, 0.15),
    Fence("word_length", 5.0, 0.35, below=True),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Accuracy parameter of the sketches (rank error about 0.7 %).
SKETCH_K = 400
#: Groups with fewer documents use the next wider group.
LEAST_ROWS = 100


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more in the same text.

    Windows are sorted with their places and compared with their neighbours,
    so a text of n words costs n log n, whatever it repeats.
    """
    none = F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(steps, none, lambda a, s: a + s)

    def repeated(windows: Column) -> Column:
        same = lambda w, other: F.coalesce(F.get(windows, other)["window"] == w["window"], F.lit(False))
        hits = F.filter(windows, lambda w, k: same(w, k + 1) | same(w, k - 1))
        return let(F.sort_array(F.transform(hits, lambda w: w["at"])), covered)

    def count(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.size(w) - 2),
            lambda first, k: F.struct(
                F.concat_ws(" ", first, F.get(w, k + 1), F.get(w, k + 2)).alias("window"), k.alias("at")
            ),
        )
        return F.when(F.size(w) < 4, none).otherwise(let(F.sort_array(windows), repeated))

    return count(words)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with word counts, base verdict and the measures that the fences judge."""
    body = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    counts = let(words_of(docs[text]), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    dups = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), F.size(F.array_distinct(a)).cast("long").alias("d")))
    bare = F.translate(body, SPACES, "")
    out = docs.withColumns({"_counts": counts, "_lines": dups})
    out = out.withColumns({
        "n_words": F.col("_counts.n"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.col("_lines.n") - F.col("_lines.d"),
        "n_repeat_words": F.col("_counts.r"),
    })
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("_lines.n")),
        "word_length": share(F.col("word_chars"), F.col("n_words")),
    })
    return out.drop("_counts", "_lines")


def thresholds(rows: DataFrame) -> DataFrame:
    """Lower and upper limits per (lang, source) from sketches of the measures of all documents with a word."""
    group = ["lang", "source"]
    names = [f.measure for f in FENCES]
    own = (
        rows.where(F.col("n_words") > 0)
        .groupBy(*group)
        .agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(F.col(m), F.lit(SKETCH_K)).alias(m) for m in names))
    )
    # the sketches are random in their compactions: fixed before they are read twice
    own = cut_lineage(own)

    def limits(level: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        q = lambda m, p: F.kll_sketch_get_quantile_double(F.col(m), F.lit(p))
        columns = [F.col("n").alias(f"{prefix}n")]
        for f in FENCES:
            middle = q(f.measure, 0.5)
            spread = F.greatest(F.lit(f.floor), F.least(middle - q(f.measure, 0.25), q(f.measure, 0.75) - middle))
            columns.append(F.round(middle + f.reach * spread, 2).alias(f"{prefix}{f.measure}_max"))
            if f.below:
                columns.append(F.round(middle - f.reach * spread, 2).alias(f"{prefix}{f.measure}_min"))
        return level.select(*keys, *columns)

    def merged(keys: list[str]) -> DataFrame:
        return own.groupBy(*keys).agg(
            F.sum("n").alias("n"), *(F.kll_merge_agg_double(F.col(m), F.lit(SKETCH_K)).alias(m) for m in names)
        )

    by_source = limits(own, group, "s_")
    by_lang = limits(merged(["lang"]), ["lang"], "l_").withColumnRenamed("lang", "_lang")
    overall = limits(merged([]).where(F.col("n") > 0), [], "o_").withColumn("_one", F.lit(1))
    wide = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("_key", F.lit(1))
    wide = wide.join(overall, F.col("_key") == F.col("_one"), "left")
    limits_of = [f"{f.measure}_max" for f in FENCES] + [f"{f.measure}_min" for f in FENCES if f.below]
    chosen = [
        F.when(F.col("s_n") >= LEAST_ROWS, F.col(f"s_{c}"))
        .when(F.col("l_n") >= LEAST_ROWS, F.col(f"l_{c}"))
        .otherwise(F.col(f"o_{c}"))
        .alias(c)
        for c in limits_of
    ]
    return wide.select(F.col("lang").alias("_t_lang"), F.col("source").alias("_t_source"), *chosen)


def quality_verdicts(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """`docs` with counts, base verdict, measures, limits and `kept`.

    The measures are taken once and stored with the columns of `docs` (`carry`: with these only, lang and source
    among them); the sketches and the verdict read that table.
    """
    rows = measured(docs)
    rows = stored(rows if carry is None else rows.select(*carry, *COUNTS, *[f.measure for f in FENCES]))
    # as a table its size is known when the join is planned, so texts are shuffled only if it is large
    limits = stored(thresholds(rows))
    meet = F.col("lang").eqNullSafe(F.col("_t_lang")) & F.col("source").eqNullSafe(F.col("_t_source"))
    outside = F.lit(False)
    for f in FENCES:
        outside = outside | F.coalesce(F.col(f.measure) > F.col(f"{f.measure}_max"), F.lit(False))
        if f.below:
            outside = outside | F.coalesce(F.col(f.measure) < F.col(f"{f.measure}_min"), F.lit(False))
    judged = rows.join(limits, meet, "left").drop("_t_lang", "_t_source")
    return judged.withColumn("kept", ~F.col("base_failed") & ~outside)
