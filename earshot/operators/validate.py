"""Data quality: each check gives the rows that break it, so a clean table gives none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.interval import RANGE, REC, overlap_flags
from earshot.schema import Rule


def violations(df: DataFrame, rules: Sequence[Rule], line: str = "_line") -> DataFrame:
    """column, line, value, problem, severity of each value that breaks its rule, in one pass over the table.

    problem is "missing column" (line is null), "null" or "invalid". A required column's errors are errors; an optional one's
    are warnings, and "NA" is let pass there.
    """
    spark, found = df.sparkSession, []
    absent = [(r.name, None, None, "missing column", "error") for r in rules if r.required and r.name not in df.columns]
    for r in rules:
        if r.name not in df.columns:
            continue
        value = F.col(f"`{r.name}`").cast("string")
        row = lambda problem, severity, v=value, n=r.name: F.struct(F.lit(n).alias("column"), F.col(line).cast("bigint").alias("line"), v.alias("value"), F.lit(problem).alias("problem"), severity.alias("severity"))
        if r.required:
            found.append(F.when(value.isNull(), row("null", F.lit("error"))))
        ok = r.ok()
        if ok is not None:
            severity = F.when(F.lit(r.required) & (value != "NA"), "error").when(F.lit(r.required) | (value != "NA"), "warning")
            if r.formats and r.check is None and not r.choices:
                severity = F.when(F.lit(r.required) & (value != "NA"), "error")
            found.append(F.when(value.isNotNull() & ~F.coalesce(ok, F.lit(False)) & severity.isNotNull(), row("invalid", severity)))
    head = spark.createDataFrame(absent, "column string, line bigint, value string, problem string, severity string")
    if not found:
        return head
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.*").unionByName(head)


def unknown_columns(df: DataFrame, rules: Sequence[Rule]) -> list[str]:
    return sorted({*df.columns} - {r.name for r in rules} - {"_line"})


def duplicates(df: DataFrame, keys: Sequence[str], line: str = "_line") -> DataFrame:
    """Keys that occur more than once (but for NA), with their lines in order, joined by commas."""
    some = df.where(F.concat_ws("", *[F.col(k).cast("string") for k in keys]) != "NA") if len(keys) == 1 else df
    grouped = some.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(line).cast("bigint"))), ",").alias("lines"))
    return grouped.where("n > 1")


def range_errors(index: DataFrame) -> DataFrame:
    """Index rows whose range is empty, reversed or begins before 0."""
    return index.where("range_offset <= range_onset or range_onset < 0")


def overlapping_ranges(index: DataFrame) -> DataFrame:
    """Index rows that overlap another row of their recording and set."""
    return overlap_flags(index, (REC, "set"), RANGE, "_overlaps").where("_overlaps").drop("_overlaps")


def duration_overflow(index: DataFrame, recordings: DataFrame) -> DataFrame:
    """Index rows that end after their recording, with its duration."""
    return index.join(recordings.select(REC, F.col("duration").alias("recording_duration")), REC).where("range_offset > recording_duration")


def orphans(df: DataFrame, of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't in ``of``."""
    return df.join(of.select(*keys).distinct(), list(keys), "left_anti")


def outdated_merges(index: DataFrame) -> DataFrame:
    """Merged sets with a source set that was imported later than they were, or is gone: set, source, reason."""
    latest = index.groupBy("set").agg(F.max("imported_at").alias("at"))
    merged = index.where("merged_from is not null and merged_from != ''").groupBy("set").agg(F.max_by("merged_from", "imported_at").alias("m"), F.max("imported_at").alias("merged_at"))
    each = merged.select("set", "merged_at", F.explode(F.split("m", ",")).alias("source"))
    both = each.join(latest.select(F.col("set").alias("source"), "at"), "source", "left")
    return both.select("set", "source", F.when(F.col("at").isNull(), "gone").when(F.col("at") > F.col("merged_at"), "imported later").alias("reason")).where("reason is not null")


def several_experiments(children: DataFrame) -> DataFrame:
    """The experiments of a dataset that has more than one."""
    names = children.select("experiment").distinct()
    return names.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).where("_n > 1").drop("_n")


def negative_ages(recordings: DataFrame, children: DataFrame) -> DataFrame:
    """Recordings dated before their child's birth."""
    both = recordings.join(children.select("child_id", "child_dob"), "child_id")
    return both.where(F.try_to_date("date_iso") < F.try_to_date("child_dob")).select(REC, "child_id", "date_iso", "child_dob")


def check_import(rows: DataFrame, recordings: DataFrame) -> DataFrame:
    """The rows of an import with ``error``, null for those that may go on: bad range, unknown recording, beyond its end, overlap within the import."""
    flagged = overlap_flags(rows, ("set", REC), RANGE, "_overlaps")
    known = flagged.join(recordings.select(REC, F.col("duration").alias("_duration"), F.lit(True).alias("_known")), REC, "left")
    error = (
        F.when(F.col("range_onset").isNull() | F.col("range_offset").isNull(), "range is missing")
        .when((F.col("range_offset") <= F.col("range_onset")) | (F.col("range_onset") < 0), "range is not valid")
        .when(F.col("_known").isNull(), "recording is unknown")
        .when(F.col("range_offset") > F.col("_duration"), "range exceeds the recording")
        .when(F.col("_overlaps"), "ranges overlap")
    )
    return known.select(*rows.columns, error.alias("error")) if "error" not in rows.columns else known.withColumn("error", error).select(*rows.columns)
