"""Readers. Each splits into a `parse_*` step over a DataFrame and a file read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertweave.functions import encode as E

ALERT_JSON = "`@timestamp` string, agent struct<id string>, rule struct<id string>"
INTERVAL_CSV = "scenario string, attack string, start double, `end` double"
ALERT_CSV = "time long, name string, ip string, host string, short string, time_label string, event_label string"
EVENT_CSV = "timestamp double, machine string, event int, label int"


def parse_alert_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(alerts, quarantine)` from `scenario, value` JSON lines.

    Blank, malformed and incomplete lines are dropped; complete lines whose rule id
    is not an integer go to the quarantine.
    """
    record = F.from_json("value", ALERT_JSON)
    parsed = lines.filter(F.trim("value") != "").select("scenario", "value", record.alias("r"))
    complete = parsed.filter(
        F.col("r.@timestamp").isNotNull() & F.col("r.agent.id").isNotNull() & F.col("r.rule.id").isNotNull()
    ).withColumn("event", F.col("r.rule.id").try_cast("int"))
    alerts = complete.filter(F.col("event").isNotNull()).select(
        "scenario",
        E.epoch_seconds(F.col("r.@timestamp")).alias("timestamp"),
        E.machine_key(F.col("scenario"), F.col("r.agent.id"), "_").alias("machine"),
        "event",
    )
    return alerts, complete.filter(F.col("event").isNull()).select("scenario", "value")


def _require_files(spark: SparkSession, path: str, pattern: str) -> None:
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    if not found:
        raise FileNotFoundError(f"no {pattern} in {path}")


def read_alert_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All `*_wazuh.json` files of a folder; the scenario is the file stem before `_wazuh`."""
    _require_files(spark, path, "*_wazuh.json")
    text = spark.read.option("pathGlobFilter", "*_wazuh.json").text(path)
    lines = text.select(F.regexp_replace("_metadata.file_name", r"_wazuh\.json$", "").alias("scenario"), "value")
    return parse_alert_json(lines)


def _numbered(raw: DataFrame, name: str, file: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Dense numbers in file order, from 0 within `keys`: by file name, block of the file and place in the block.

    One task reads a block in order, so a row's place in it plus the rows of the
    blocks before gives its number without a sort. Spark deals files to tasks by
    size, so task numbers alone would not follow the names.
    """
    columns = raw.columns
    rows = raw.select(
        *columns,
        F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    blocks = rows.groupBy(*keys, "_block").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = rows.join(blocks, [*keys, "_block"])
    return placed.select(*columns, (F.col("_mid") - F.col("_first") + F.col("_offset")).alias(name))


def read_attack_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Interval CSV with the file position that decides between equal starts; many files follow their names."""
    raw = spark.read.schema(INTERVAL_CSV).csv(path, header=True, mode="FAILFAST")
    return _numbered(raw, "position", F.col("_metadata.file_path"))


def read_alert_csv(
    spark: SparkSession, folder: str, scenarios: Sequence[str] | None = None, per_folder: bool = False
) -> DataFrame:
    """Alert CSV with an exact header; adds `scenario` and a dense `source_row`.

    One file per scenario by default; `per_folder` reads `scenario=<name>/` folders
    of part files.
    """
    reader = spark.read.schema(ALERT_CSV).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    if per_folder:
        raw = reader.schema(ALERT_CSV + ", scenario string").csv(folder)
        scenario, file = F.col("scenario"), F.col("_metadata.file_name")
    else:
        raw = reader.csv([f"{folder}/{s}.csv" for s in scenarios])
        scenario, file = F.regexp_replace("_metadata.file_name", r"\.csv$", ""), F.lit("")
    return _numbered(raw.withColumn("scenario", scenario), "source_row", file, ["scenario"])


def read_canonical(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def _event_words(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Non-blank lines with their words, and whether each word is a non-negative integer that fits 64 bits."""
    clean = F.regexp_replace("line", "[\r\n]+$", "")
    rows = lines.withColumn("line", clean).filter(F.trim("line") != "")
    words = F.filter(F.split("line", r"[ \t]+"), lambda w: w != "")
    rows = rows.withColumn("_words", words)
    # token by token: one pattern over a very long line would recurse too deep
    return rows, F.forall("_words", lambda w: w.rlike("^[0-9]+$") & w.try_cast("long").isNotNull())


def rejected_event_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """The lines that `parse_event_lines` does not take: a non-ASCII, non-integer, negative or over-long token."""
    rows, valid = _event_words(lines)
    return rows.filter(~valid).select(*keep, "line")


def parse_event_lines(lines: DataFrame, *keep: str, strict: bool = False) -> DataFrame:
    """Integer token arrays (64 bits) from text lines; only line ends are stripped, blank lines skipped.

    A line with a token that is no non-negative integer goes to
    `rejected_event_lines`, or fails the job when `strict`.
    """
    rows, valid = _event_words(lines)
    if strict:
        bad = F.raise_error(F.concat(F.lit("not an event sequence: "), F.substring("line", 1, 80)))
        rows = rows.withColumn("_words", F.when(valid, F.col("_words")).otherwise(bad))
    else:
        rows = rows.filter(valid)
    return rows.select(*keep, "line", F.transform("_words", lambda w: w.cast("long")).alias("tokens"))


def read_event_sequences(spark: SparkSession, sources: dict[str, str], strict: bool = True) -> DataFrame:
    """Sequences of several text files, `sources` = {source name: path}."""
    frames = [
        spark.read.text(path, lineSep="\n").select(F.lit(name).alias("source"), F.col("value").alias("line"))
        for name, path in sources.items()
    ]
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionByName(frame)
    return parse_event_lines(lines, "source", strict=strict)


def read_processed_events(spark: SparkSession, path: str) -> DataFrame:
    """Processed event CSV with the scenario from the machine key; `row_id` follows file names and places."""
    rows = spark.read.schema(EVENT_CSV).csv(path, header=True, mode="FAILFAST")
    return _numbered(rows.withColumn("scenario", E.scenario_of(F.col("machine"))), "row_id", F.col("_metadata.file_path"))


def read_report_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Report CSV whose comment lines start with a hash sign."""
    return spark.read.schema(schema).option("comment", "#").csv(path, header=header)


def complete_records(records: DataFrame) -> DataFrame:
    """Complete run records, one row per operating point (`order` = its place in the grid)."""
    kept = records.filter((F.col("status") == "complete") & (F.size("operating_points") > 0))
    others = [c for c in records.columns if c != "operating_points"]
    return kept.select(*others, F.posexplode("operating_points").alias("order", "point"))


def read_run_records(spark: SparkSession, path: str, schema, multi_line: bool = True) -> DataFrame:
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", multi_line).json(path)
    return complete_records(raw)
