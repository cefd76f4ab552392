"""The synthetic tables as a dataset: events become segments, users recordings. The same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.clock import DAY

BASE = 1_704_067_200_000_000  # 2024-01-01, in microseconds
VCM = ("C", "N", "Y", "L", "J", "U")
TURN_TYPES = ("TIMR", "TIFR", "TIFI", "NT", "TIME")
DAYS = 31


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _nth(values: tuple[str, ...], by: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(by) + 1).cast("int"))


def segments(spark: SparkSession, sf_dir: str, lists: bool = False) -> DataFrame:
    """row_no, recording_filename, segment_onset, segment_offset, speaker_type, vcm_type and the counts; with ``lists`` cries and vfxs too."""
    onset = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - BASE) / 1000)
    kind = F.when(F.col("event_type") == "click", "CHI").when(F.col("event_type") == "view", "FEM").when(F.col("event_type") == "purchase", "MAL").when(F.col("event_type") == "signup", "OCH").otherwise("NA")
    out = events(spark, sf_dir).select(
        F.col("event_id").alias("row_no"),
        F.concat(F.lit("rec"), F.col("user_id").cast("string")).alias("recording_filename"),
        onset.alias("segment_onset"),
        (onset + F.round(F.col("value") * 100).cast("bigint") * 1000).alias("segment_offset"),
        kind.alias("speaker_type"),
        _nth(VCM, "event_id % 6").alias("vcm_type"),
        *[(F.col("event_id") % m).cast("double").alias(c) for c, m in (("words", 11), ("syllables", 13), ("phonemes", 17))],
        (F.col("event_id") % 4).cast("double").alias("utterances_count"),
        (F.col("event_id") % 4 * 250).cast("double").alias("utterances_length"),
        (F.col("event_id") % 3 * 400).cast("double").alias("child_cry_vfx_len"),
        _nth(TURN_TYPES, "event_id % 5").alias("lena_conv_turn_type"),
    )
    if lists:
        some = lambda m: F.slice(F.array(*[F.struct(F.lit(0.0).alias("start"), F.lit(0.4).alias("end"))] * m), 1, (F.col("row_no") % m).cast("int"))
        out = out.drop("vcm_type").withColumns({"cries": some(3), "vfxs": some(2)})
    return out


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each user: child, session, experiment, date, start time and duration."""
    own = segments(spark, sf_dir).groupBy("recording_filename").agg(F.max("segment_offset").alias("duration"))
    u = F.substring("recording_filename", 4, 20).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return own.select(
        "recording_filename",
        (u % 50).alias("child_id"),
        (u % 75).alias("session_id"),
        F.lit("earshot").alias("experiment"),
        F.concat(F.lit("2024-01-"), two(u % 28 + 1)).alias("date_iso"),
        F.concat(two(u % 24), F.lit(":"), two(u * 7 % 60)).alias("start_time"),
        _nth(("lena", "usb", "olympus"), "cast(substring(recording_filename, 4, 20) AS bigint) % 3").alias("recording_device_type"),
        F.when(u % 7 == 0, "1").when(u % 7 == 1, "maybe").otherwise("0").alias("discard"),
        "duration",
    )


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = events(spark, sf_dir).select((F.col("user_id") % 50).alias("child_id")).distinct()
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    c = F.col("child_id")
    return ids.select(
        "child_id",
        F.concat(F.lit("2022-"), two(c % 12 + 1), F.lit("-"), two(c % 28 + 1)).alias("child_dob"),
        F.when(c % 2 == 0, "f").otherwise("m").alias("child_sex"),
        F.when(c % 3 == 0, "eng").when(c % 3 == 1, "eng; fra").otherwise("tsi;fra").alias("languages"),
        F.when(c % 3 == 0, "Y").otherwise("N").alias("monoling"),
        F.when(c % 11 == 0, None).otherwise("Y").alias("normative"),
        F.lit("earshot").alias("experiment"),
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sets, for each recording and day: a has [0, 0.75) of it, b [0.25, 1), c [0.5, 0.9)."""
    recs = events(spark, sf_dir).select(F.concat(F.lit("rec"), F.col("user_id").cast("string")).alias("recording_filename")).distinct()
    spans = F.array(*[F.struct(F.lit(s).alias("set"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for s, a, b in SETS])
    each = recs.select("recording_filename", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DAYS - 1).cast("bigint"))).alias("day")).select("*", F.explode(spans).alias("s"))
    rec = F.col("recording_filename")
    return each.select(F.col("s.set").alias("set"), rec, (F.col("day") * DAY + F.col("s.a")).alias("range_onset"), (F.col("day") * DAY + F.col("s.b")).alias("range_offset"), F.concat(rec, F.lit("_"), F.col("day").cast("string"), F.lit(".raw")).alias("raw_filename"))


SETS = (("a", 0, DAY * 3 // 4), ("b", DAY // 4, DAY), ("c", DAY // 2, DAY * 9 // 10))


def annotated(spark: SparkSession, sf_dir: str, lists: bool = False) -> DataFrame:
    """The segments in each set; set b has every second one."""
    these = segments(spark, sf_dir, lists)
    sets = F.when(F.col("row_no") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("c")))
    return these.withColumn("set", F.explode(sets))


#: The same tables for DuckDB: seg, rec, chi, idx, ann (segments in sets).
SQL = f"""
seg AS (
  SELECT row_no, recording_filename, segment_onset, segment_onset + len AS segment_offset, speaker_type, vcm_type, words, syllables, phonemes, utterances_count, utterances_length, child_cry_vfx_len, lena_conv_turn_type
  FROM (
    SELECT event_id AS row_no, 'rec' || user_id AS recording_filename, (epoch_us(ts) - {BASE}) // 1000 AS segment_onset, CAST(round(value * 100) AS BIGINT) * 1000 AS len,
      CASE event_type WHEN 'click' THEN 'CHI' WHEN 'view' THEN 'FEM' WHEN 'purchase' THEN 'MAL' WHEN 'signup' THEN 'OCH' ELSE 'NA' END AS speaker_type,
      (['C','N','Y','L','J','U'])[event_id % 6 + 1] AS vcm_type, (event_id % 11)::DOUBLE AS words, (event_id % 13)::DOUBLE AS syllables, (event_id % 17)::DOUBLE AS phonemes,
      (event_id % 4)::DOUBLE AS utterances_count, (event_id % 4 * 250)::DOUBLE AS utterances_length, (event_id % 3 * 400)::DOUBLE AS child_cry_vfx_len,
      (['TIMR','TIFR','TIFI','NT','TIME'])[event_id % 5 + 1] AS lena_conv_turn_type
    FROM events)
),
rec AS (
  SELECT recording_filename, u % 50 AS child_id, u % 75 AS session_id, 'earshot' AS experiment, '2024-01-' || lpad((u % 28 + 1)::VARCHAR, 2, '0') AS date_iso,
    lpad((u % 24)::VARCHAR, 2, '0') || ':' || lpad((u * 7 % 60)::VARCHAR, 2, '0') AS start_time, (u % 24 * 3600 + u * 7 % 60 * 60) * 1000 AS begins,
    (['lena','usb','olympus'])[u % 3 + 1] AS recording_device_type, CASE u % 7 WHEN 0 THEN '1' WHEN 1 THEN 'maybe' ELSE '0' END AS discard, duration
  FROM (SELECT recording_filename, substr(recording_filename, 4)::BIGINT AS u, max(segment_offset) AS duration FROM seg GROUP BY recording_filename)
),
chi AS (
  SELECT c AS child_id, '2022-' || lpad((c % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((c % 28 + 1)::VARCHAR, 2, '0') AS child_dob, CASE WHEN c % 2 = 0 THEN 'f' ELSE 'm' END AS child_sex,
    CASE c % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'eng; fra' ELSE 'tsi;fra' END AS languages, CASE WHEN c % 3 = 0 THEN 'Y' ELSE 'N' END AS monoling, CASE WHEN c % 11 = 0 THEN NULL ELSE 'Y' END AS normative
  FROM (SELECT DISTINCT user_id % 50 AS c FROM events)
),
idx AS (
  SELECT s.name AS set, recording_filename, day * {DAY} + s.a AS range_onset, day * {DAY} + s.b AS range_offset, recording_filename || '_' || day || '.raw' AS raw_filename
  FROM (SELECT DISTINCT 'rec' || user_id AS recording_filename FROM events), (SELECT unnest(range(0, {DAYS})) AS day), (VALUES {", ".join(str(s) for s in SETS)}) s(name, a, b)
),
ann AS (SELECT * FROM seg, (VALUES ('a'), ('b'), ('c')) s(set) WHERE s.set != 'b' OR row_no % 2 = 0)
"""
