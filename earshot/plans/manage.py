"""Bookkeeping of datasets: overlays, discarded rows, ages, imports, renames, merges and overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.interval import RANGE, REC, SEGMENT, intersect_sets, merge_sets
from earshot.operators.validate import check_import
from earshot.schema import SET_METADATA

INDEX_KEY = ("set", REC, *RANGE)


def overlay(table: DataFrame, overlays: Sequence[DataFrame], key: str) -> DataFrame:
    """Replace values by the overlays' non-null ones, in the order given; new columns are added."""
    for more in overlays:
        cols = [c for c in more.columns if c != key]
        named = more.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols]).dropDuplicates([key])
        joined = table.join(named, key, "left")
        kept = [F.coalesce(F.col(f"_new_{c}").cast(table.schema[c].dataType), F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns]
        table = joined.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in cols if c not in table.columns])
    return table


def split_discarded(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded): rows whose discard is 1 go; any other text counts as 0."""
    if "discard" not in table.columns:
        return table, table.where(F.lit(False))
    gone = F.coalesce(F.col("discard").cast("string").try_cast("double") == 1, F.lit(False))
    return table.where(~gone), table.where(gone)


def ages(recordings: DataFrame, children: DataFrame, zero_is_null: bool = False) -> DataFrame:
    """Recordings with the child's age in months, age_days, age_weeks and age_years; null where a date isn't readable."""
    both = recordings.join(children.select("child_id", F.col("child_dob").alias("_dob")), "child_id", "left")
    d = F.datediff(F.try_to_date("date_iso"), F.try_to_date("_dob"))
    d = F.when(d != 0, d) if zero_is_null else d
    return both.withColumns({"age": d / F.lit(365.25 / 12), "age_days": d, "age_weeks": d / F.lit(7.0), "age_years": d / F.lit(365.25)}).drop("_dob")


def recordings_from_list(recordings: DataFrame, names: DataFrame | Sequence[str], column: str = REC) -> DataFrame:
    """The recordings of a whitelist, given as names or a frame that has them; null and NA are left out, unknown names raise ValueError."""
    if not isinstance(names, DataFrame):
        names = recordings.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    wanted = names.select(F.col(column).alias(REC)).where(f"{REC} is not null and {REC} != 'NA'").distinct()
    if missing := wanted.join(recordings, REC, "left_anti").limit(10).collect():
        raise ValueError(f"unknown recordings: {sorted(r[0] for r in missing)}")
    return recordings.join(wanted, REC, "left_semi")


def keep_last(index: DataFrame, keys: Sequence[str] = INDEX_KEY, at: str = "imported_at") -> DataFrame:
    """Of rows of equal keys the one that was imported last."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), *[F.col(c).desc() for c in index.columns if c not in (*keys, at)])
    return index.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def import_rows(index: DataFrame, rows: DataFrame, recordings: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new index, rejected rows with error). A row that overlaps the index is rejected unless it is of equal keys and ``overwrite``."""
    checked = check_import(rows, recordings)
    have = index.select("set", REC, *[F.col(c).alias(f"_{c}") for c in RANGE])
    clash = (F.col("range_onset") < F.col("_range_offset")) & (F.col("_range_onset") < F.col("range_offset"))
    same = (F.col("range_onset") == F.col("_range_onset")) & (F.col("range_offset") == F.col("_range_offset"))
    blocked = checked.join(have, ["set", REC]).where(clash & ~(same & F.lit(overwrite))).select(*INDEX_KEY).distinct().withColumn("_blocked", F.lit(True))
    full = checked.join(blocked, list(INDEX_KEY), "left").withColumn("error", F.coalesce("error", F.when(F.col("_blocked"), "it overlaps rows that are imported already"))).drop("_blocked")
    good, bad = full.where("error is null"), full.where("error is not null")
    return keep_last(index.unionByName(good.drop("error"), allowMissingColumns=True)), bad


def full_ranges(recordings: DataFrame, new_set: str, fmt: str, extension: str) -> DataFrame:
    """Index rows that take each recording as a whole, raw files being named like it."""
    raw = F.concat(F.regexp_replace(REC, r"\.[^./]*$", ""), F.lit(f".{extension}"))
    return recordings.select(F.lit(new_set).alias("set"), REC, F.lit(0).cast("bigint").alias("time_seek"), F.lit(0).cast("bigint").alias("range_onset"), F.col("duration").alias("range_offset"), raw.alias("raw_filename"), F.lit(fmt).alias("format"))


def annotation_filename(rec: str = REC) -> Column:
    """<recording without its suffix>_<onset>_<offset>.csv"""
    return F.concat(F.regexp_replace(rec, r"\.[^./]*$", ""), F.lit("_"), "range_onset", F.lit("_"), "range_offset", F.lit(".csv"))


def attach(segments: DataFrame, index: DataFrame) -> DataFrame:
    """The index's columns on each segment of its file, cut to its range. On a clash the index's value stays, but for raw_filename."""
    keys = ["set", "annotation_filename"]
    drop = [c for c in segments.columns if c in index.columns and c not in (*keys, "raw_filename")]
    left = index.drop("raw_filename") if "raw_filename" in segments.columns else index
    both = segments.drop(*drop).join(left, keys)
    clamp = lambda c: F.greatest(F.least(F.col(c), F.col("range_offset")), F.col("range_onset"))
    return both.withColumns({c: clamp(c) for c in SEGMENT}).where("segment_offset > segment_onset")


def shift(segments: DataFrame, time_seek: Column | int) -> DataFrame:
    return segments.withColumns({c: F.col(c) + time_seek for c in SEGMENT})


def remove_set(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("set") != name)


def rename_set(index: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a set, in merged_from too. The new name may not be in use."""
    if index.where(F.col("set") == new).limit(1).count():
        raise ValueError(f"there is a set {new}")
    if not index.where(F.col("set") == old).limit(1).count():
        raise ValueError(f"there is no set {old}")
    out = index.withColumn("set", F.when(F.col("set") == old, new).otherwise(F.col("set")))
    if "merged_from" in index.columns:
        names = F.transform(F.split("merged_from", ","), lambda x: F.when(x == old, new).otherwise(x))
        out = out.withColumn("merged_from", F.array_join(names, ","))
    return out


def rename_recording(tables: Sequence[DataFrame], old: str, new: str) -> list[DataFrame]:
    """Rename a recording in each table that names it."""
    return [t.withColumn(REC, F.when(F.col(REC) == old, new).otherwise(F.col(REC))) for t in tables]


def merge(segments: DataFrame, index: DataFrame, left: str, right: str, left_columns: Sequence[str], right_columns: Sequence[str], output: str) -> tuple[DataFrame, DataFrame]:
    """Segments and index of a set with the columns of two, over the time that both annotate."""
    common = intersect_sets(index, [left, right])
    ranges = lambda s: common.where(F.col("set") == s).select(REC, *RANGE).distinct()
    both = ranges(left).join(ranges(right), [REC, *RANGE])

    def side(s: str) -> DataFrame:
        mine = segments.where(F.col("set") == s).drop("set", *RANGE)
        return mine.join(both, REC).where("segment_onset < range_offset and range_onset < segment_offset").withColumns({c: F.greatest(F.least(F.col(c), F.col("range_offset")), F.col("range_onset")) for c in SEGMENT})

    merged = merge_sets(side(left), side(right), left_columns, right_columns).withColumn("set", F.lit(output))
    return merged, both.select(F.lit(output).alias("set"), REC, *RANGE, F.lit(f"{left},{right}").alias("merged_from"))


def sets_report(index: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row for each set: annotated ms, and its metadata if given."""
    out = index.groupBy("set").agg(F.sum(F.col("range_offset") - F.col("range_onset")).alias("duration"))
    return out if metadata is None else metadata.join(out, "set", "left").withColumn("duration", F.coalesce("duration", F.lit(0)))


def unknown_fields(metadata: DataFrame) -> list[str]:
    return sorted({*metadata.columns} - {"set", "duration", *SET_METADATA})


def overview(recordings: DataFrame, children: DataFrame) -> DataFrame:
    """One row: counts, total duration, dates, ages in days, sexes, and how many children are monolingual or normative."""
    aged = ages(recordings, children)
    rec = aged.agg(F.count("*").alias("recordings"), F.count_distinct("child_id").alias("recorded_children"), F.sum("duration").alias("total_duration"), F.min("date_iso").alias("first_date"), F.max("date_iso").alias("last_date"), F.min("age_days").alias("least_age_days"), F.max("age_days").alias("greatest_age_days"))
    has = lambda c, *v: F.count(F.when(F.lower(c).isin(*v), 1)) if c in children.columns else F.lit(None).cast("bigint")
    chi = children.agg(F.count_distinct("child_id").alias("children"), has("child_sex", "m").alias("boys"), has("child_sex", "f").alias("girls"), has("monoling", "y").alias("monolingual"), has("monoling", "n").alias("multilingual"), has("normative", "y").alias("normative"))
    return rec.crossJoin(chi)


def devices(recordings: DataFrame) -> DataFrame:
    """Recordings and their duration for each device type."""
    return recordings.groupBy("recording_device_type").agg(F.count("*").alias("recordings"), F.sum("duration").alias("duration"))


def languages(children: DataFrame) -> DataFrame:
    """How many children hear each of the languages that are listed with semicolons."""
    each = children.select("child_id", F.explode(F.split("languages", ";")).alias("language")).withColumn("language", F.trim("language"))
    return each.where("language != ''").groupBy("language").agg(F.count_distinct("child_id").alias("children"))


def classifications(raw: DataFrame, answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each answer of a volunteer with its chunk: annotations arrays are unnested, answers looked up by workflow, task and number."""
    each = raw.select("id", "user_id", "subject_id", "workflow_id", F.explode("annotations").alias("a")).select("id", "user_id", "subject_id", "workflow_id", F.col("a.task").alias("task_id"), F.col("a.value").cast("string").alias("answer_id"))
    return each.join(answers, ["workflow_id", "task_id", "answer_id"]).join(chunks, "subject_id")


def update_chunks(chunks: DataFrame, updates: DataFrame, key: str = "index") -> DataFrame:
    """Write back the state of uploaded chunks."""
    return overlay(chunks, [updates], key)


def next_upload(chunks: DataFrame, amount: int) -> DataFrame:
    """The first chunks that aren't uploaded yet."""
    return chunks.where(~F.coalesce(F.col("uploaded"), F.lit(False))).orderBy("index").limit(amount)


def orphan_chunks(chunks: DataFrame) -> DataFrame:
    """Uploaded chunks that belong to no subject set."""
    return chunks.where("uploaded and project_id is not null and zooniverse_id is not null and (subject_set is null or subject_set = '')")


def anonymise(lines: DataFrame, replacements: dict[tuple[str, str], str], column: str = "value") -> DataFrame:
    """Replace attribute values of XML nodes, line by line: {(node, attribute): value}; a value of only a date keeps the time of day."""
    c = F.col(column)
    for (node, attribute), value in replacements.items():
        date_only = len(value) == 10 and value[4] == value[7] == "-"
        pattern = rf'({attribute}=")\d{{4}}-\d{{2}}-\d{{2}}' if date_only else rf'({attribute}=")[^"]*'
        c = F.when(c.rlike(rf"<{node}\b"), F.regexp_replace(c, pattern, "$1" + value.replace("$", r"\$"))).otherwise(c)
    return lines.withColumn(column, c)


def printable(column: str, unit: str) -> Column:
    """A duration as text in ms, s, m or h, with one decimal but for ms."""
    size = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}[unit]
    return F.concat(F.col(column).cast("string") if unit == "ms" else F.format_string("%.1f", F.col(column) / size), F.lit(f" {unit}"))
