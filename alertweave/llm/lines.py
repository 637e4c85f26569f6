"""Line dedup by the spread of a line over sites.

Every line (trimmed, with a word) is hashed; per line hash a HyperLogLog sketch
of its sites is merged by aggregation. Lines estimated far above `min_sites` are
boilerplate, lines near it get an exact distinct count. Of each boilerplate line
the first occurrence in the corpus stays, so that no content is lost where whole
documents are copied across sites; all others go.

Defined cases: a null text stays null; a null source is one site of its own;
"first" is the smallest doc_id (nulls last), then the smaller text hash, then
the earlier line; rows equal in doc_id and text count as one document and keep
the same lines; a document may end with an empty text but is never dropped. If
`docs` has n_chars, it follows the text; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import SPACES, let, stored
from alertweave.session import cut_lineage

#: A line on so many sites or more is boilerplate.
MIN_SITES = 10
#: Sketches of 2**LG_K registers; five standard errors count as near the threshold.
LG_K = 12
NEAR = 5 * 1.04 / 2 ** (LG_K / 2)


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row per line with a word: document key, place, line hash and site."""
    return (
        docs.select(
            F.col("doc_id").alias("_id"),
            F.xxhash64("text").alias("_text"),
            F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("_site"),
            F.posexplode(F.split("text", "\n")).alias("_at", "_raw"),
        )
        .withColumn("_trimmed", F.btrim("_raw", F.lit(SPACES)))
        .where(F.col("_trimmed") != "")
        .select("_id", "_text", "_at", "_site", F.unhex(F.md5("_trimmed")).alias("_line"))
    )


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines found on at least `min_sites` sites."""
    lines = _occurrences(docs)
    spread = lines.groupBy("_line").agg(F.hll_sketch_agg("_site", F.lit(LG_K)).alias("_sketch"))
    spread = spread.select("_line", F.hll_sketch_estimate("_sketch").alias("_sites"))
    low, high = int(min_sites * (1 - NEAR)), min_sites * (1 + NEAR) + 1
    wide = cut_lineage(spread.where(F.col("_sites") >= low))
    near = wide.where(F.col("_sites") <= high).select("_line")
    exact = (
        lines.join(near, "_line", "left_semi")
        .select("_line", "_site")
        .groupBy("_line")
        .agg(F.countDistinct("_site").alias("_sites"))
        .where(F.col("_sites") >= min_sites)
    )
    return cut_lineage(wide.where(F.col("_sites") > high).select("_line").union(exact.select("_line")))


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per document key (_id, _text) the places of the lines that go."""
    hits = stored(_occurrences(docs).drop("_site").join(boilerplate_lines(docs, min_sites), "_line"))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_text", "_at")
    first = hits.groupBy("_line").agg(F.min(order).alias("_first"))
    later = hits.join(first, "_line").where(~order.eqNullSafe(F.col("_first")))
    return later.groupBy("_id", "_text").agg(F.collect_set("_at").alias("_gone"))


def _without(text: Column, gone: Column) -> Column:
    """`text` without the lines at the places `gone`."""

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n"), kept)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """`docs` with its texts cleaned; `counts` adds n_lines (with a word, before) and n_removed."""
    gone = removed_lines(docs, min_sites).withColumnsRenamed({"_id": "_gone_id", "_text": "_gone_text"})
    meet = docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (F.xxhash64(docs["text"]) == F.col("_gone_text"))
    # the texts meet the places by a sort-merge join at every size: the places grow with the texts
    joined = docs.join(gone.hint("merge"), meet, "left")
    if counts:
        bare = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
        joined = joined.withColumns({
            "n_lines": F.coalesce(F.size(bare), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        })
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_gone"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop("_gone_id", "_gone_text", "_gone")
