"""The registered queries over the synthetic tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions.clock import DAY, HOUR
from earshot.functions.metrics import aclew_bundle, lena_bundle
from earshot.operators import clock, conversations, derive, interval, reliability, sampling, validate
from earshot.operators.interval import RANGE, REC, SEGMENT
from earshot.plans import adapter, manage
from earshot.plans.metrics import extract, turn_flags
from earshot.schema import Rule
from earshot.sources.formats import mapped


class Tables:
    """The adapter's tables, made when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    seg = cached_property(lambda self: adapter.segments(self.spark, self.sf_dir))
    rec = cached_property(lambda self: adapter.recordings(self.spark, self.sf_dir))
    chi = cached_property(lambda self: adapter.children(self.spark, self.sf_dir))
    idx = cached_property(lambda self: adapter.index(self.spark, self.sf_dir))
    ann = cached_property(lambda self: adapter.annotated(self.spark, self.sf_dir))
    lists = cached_property(lambda self: adapter.annotated(self.spark, self.sf_dir, lists=True))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @property
    def lines(self) -> DataFrame:
        """Line items as a large interval table: a supplier is a recording, quantity days from the ship date."""
        on = F.floor((F.unix_micros(F.col("l_shipdate").cast("timestamp"))) / 1000)
        return self.read("lineitem").select(F.col("l_suppkey").alias(REC), "l_orderkey", "l_linenumber", on.alias("segment_onset"), (on + F.col("l_quantity").cast("bigint") * DAY).alias("segment_offset"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQLS: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if kind in ("double", "float") else F.col(f"`{n}`") for n, kind in df.dtypes])


def query(sql: str | None = None):
    """Register a query; its SQL is a select, or further CTEs and a select, over the adapter's tables."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        QUERIES[f.__name__].__name__ = f.__name__
        if sql is not None:
            body = sql.strip()
            SQLS[f.__name__] = f"WITH {adapter.SQL}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
        return f

    return add


LINE = "lin AS (SELECT l_suppkey AS recording_filename, l_orderkey, l_linenumber, epoch_us(l_shipdate) // 1000 AS segment_onset, epoch_us(l_shipdate) // 1000 + l_quantity::BIGINT * 86400000 AS segment_offset FROM lineitem)"

# scans, filters, projections


@query("SELECT row_no, recording_filename, segment_onset, segment_offset, speaker_type FROM ann WHERE set = 'b' AND speaker_type = 'CHI'")
def segments_by_set(t: Tables) -> DataFrame:
    return t.ann.where("set = 'b' and speaker_type = 'CHI'").select("row_no", REC, *SEGMENT, "speaker_type")


@query("SELECT recording_filename, duration, child_id FROM rec WHERE recording_filename IN (SELECT 'rec' || o_custkey FROM orders)")
def recordings_whitelist(t: Tables) -> DataFrame:
    wanted = t.read("orders").select(F.concat(F.lit("rec"), F.col("o_custkey").cast("string")).alias(REC)).distinct()
    return manage.recordings_from_list(t.rec, wanted.join(t.rec, REC, "left_semi")).select(REC, "duration", "child_id")


@query("SELECT 'kept' AS part, count(*) AS n, CAST(sum(duration) AS BIGINT) AS duration FROM rec WHERE discard != '1' UNION ALL SELECT 'discarded', count(*), CAST(sum(duration) AS BIGINT) FROM rec WHERE discard = '1'")
def discard_split(t: Tables) -> DataFrame:
    kept, gone = manage.split_discarded(t.rec)
    report = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("duration").alias("duration"))
    return report(kept, "kept").unionByName(report(gone, "discarded"))


@query("SELECT child_id, CASE WHEN child_id % 4 = 0 THEN '2021-06-15' ELSE child_dob END AS child_dob, CASE WHEN child_id % 6 = 0 THEN 'x' WHEN child_id % 4 = 0 THEN 'y' END AS note FROM chi")
def overlay_metadata(t: Tables) -> DataFrame:
    base = t.chi.select("child_id", "child_dob")
    one = t.chi.where("child_id % 4 = 0").select("child_id", F.lit("2021-06-15").alias("child_dob"), F.lit("y").alias("note"))
    two = t.chi.where("child_id % 6 = 0").select("child_id", F.lit(None).cast("string").alias("child_dob"), F.lit("x").alias("note"))
    return manage.overlay(base, [one, two], "child_id")


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'CHI' WHEN 'view' THEN 'FEM' ELSE 'NA' END AS speaker_type, count(*) AS n FROM events GROUP BY ALL")
def speaker_map(t: Tables) -> DataFrame:
    return t.read("events").withColumn("speaker_type", mapped(F.col("event_type"), {"click": "CHI", "view": "FEM"})).groupBy("event_type", "speaker_type").agg(F.count("*").alias("n"))


@query("SELECT recording_filename, round(d / (365.25 / 12), 6) AS age, d AS age_days, round(d / 7.0, 6) AS age_weeks, round(d / 365.25, 6) AS age_years FROM (SELECT *, date_diff('day', child_dob::DATE, date_iso::DATE) AS d FROM rec JOIN chi USING (child_id))")
def ages_months(t: Tables) -> DataFrame:
    return manage.ages(t.rec, t.chi).select(REC, "age", F.col("age_days").cast("bigint").alias("age_days"), "age_weeks", "age_years")


@query("SELECT row_no, strftime(make_timestamp((epoch_us(date_iso::TIMESTAMP) // 1000 + begins + segment_onset) * 1000), '%Y-%m-%d %H:%M:%S') AS onset_time, strftime(make_timestamp((epoch_us(date_iso::TIMESTAMP) // 1000 + begins + segment_offset) * 1000), '%Y-%m-%d %H:%M:%S') AS offset_time FROM seg JOIN rec USING (recording_filename)")
def segment_timestamps(t: Tables) -> DataFrame:
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return clock.segment_timestamps(t.seg, t.rec).select("row_no", show("onset_time"), show("offset_time"))


# interval algebra


@query(f"SELECT row_no, recording_filename, greatest(segment_onset, {5 * DAY}) AS segment_onset, least(segment_offset, {20 * DAY}) AS segment_offset FROM seg WHERE least(segment_offset, {20 * DAY}) > greatest(segment_onset, {5 * DAY})")
def clip_segments(t: Tables) -> DataFrame:
    return interval.clip(t.seg, 5 * DAY, 20 * DAY).select("row_no", REC, *SEGMENT)


_PAIR = "a.recording_filename = b.recording_filename AND a.row_no != b.row_no AND a.segment_onset < b.segment_offset AND b.segment_onset < a.segment_offset"


@query(f"SELECT row_no, recording_filename, EXISTS (SELECT 1 FROM seg b WHERE {_PAIR}) AS overlaps FROM seg a")
def overlap_flags(t: Tables) -> DataFrame:
    return interval.overlap_flags(t.seg).select("row_no", REC, "overlaps")


@query(f"{LINE} SELECT recording_filename, count(*) AS islands, CAST(sum(hi - lo) AS BIGINT) AS covered FROM (SELECT recording_filename, island, min(segment_onset) AS lo, max(segment_offset) AS hi FROM (SELECT *, sum(CASE WHEN before >= segment_onset THEN 0 ELSE 1 END) OVER (PARTITION BY recording_filename ORDER BY segment_onset, segment_offset, l_orderkey, l_linenumber) AS island FROM (SELECT *, max(segment_offset) OVER (PARTITION BY recording_filename ORDER BY segment_onset, segment_offset, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lin WHERE segment_offset > segment_onset)) GROUP BY ALL) GROUP BY ALL")
def merged_lineitem_ranges(t: Tables) -> DataFrame:
    islands = interval.merge_ranges(t.lines, (REC,), SEGMENT)
    return islands.groupBy(REC).agg(F.count("*").alias("islands"), F.sum(F.col("segment_offset") - F.col("segment_onset")).alias("covered"))


_I2 = "c2 AS (SELECT a.recording_filename, greatest(a.range_onset, b.range_onset) AS x, least(a.range_offset, b.range_offset) AS y FROM idx a JOIN idx b USING (recording_filename) WHERE a.set = 'a' AND b.set = 'b' AND a.range_onset < b.range_offset AND b.range_onset < a.range_offset)"
_CUT = "SELECT set, i.recording_filename, greatest(range_onset, x) AS range_onset, least(range_offset, y) AS range_offset FROM idx i JOIN {c} c USING (recording_filename) WHERE set IN ({sets}) AND range_onset < y AND x < range_offset"


@query(f"{_I2} {_CUT.format(c='c2', sets=repr('a') + ',' + repr('b'))}")
def intersect_two_sets(t: Tables) -> DataFrame:
    return interval.intersect_sets(t.idx, ["a", "b"]).select("set", REC, *RANGE)


_BY_DAY = f"di AS (SELECT *, unnest(range(range_onset // {DAY}, (range_offset - 1) // {DAY} + 1)) AS day FROM idx)"
_MEET = "JOIN di b USING (recording_filename, day) WHERE {x} < b.range_offset AND b.range_onset < {y}"


@query(f"""{_BY_DAY}, c2 AS (SELECT DISTINCT recording_filename, day, greatest(a.range_onset, b.range_onset) AS x, least(a.range_offset, b.range_offset) AS y FROM di a {_MEET.format(x='a.range_onset', y='a.range_offset')} AND a.set = 'a' AND b.set = 'b'),
c3 AS (SELECT DISTINCT recording_filename, day, greatest(x, range_onset) AS x, least(y, range_offset) AS y FROM c2 {_MEET.format(x='x', y='y')} AND b.set = 'c')
SELECT DISTINCT b.set, recording_filename, greatest(range_onset, x) AS range_onset, least(range_offset, y) AS range_offset FROM c3 {_MEET.format(x='x', y='y')} AND b.set IN ('a', 'b', 'c')""")
def intersect_three_sets(t: Tables) -> DataFrame:
    return interval.intersect_sets(t.idx, ["a", "b", "c"], bucket_ms=DAY).select("set", REC, *RANGE)


_WANTED = f"want AS (SELECT recording_filename, {2 * DAY + 5 * HOUR} AS x, {6 * DAY + 3 * HOUR} AS y FROM rec UNION ALL SELECT recording_filename, {9 * DAY} AS x, {9 * DAY + HOUR} FROM rec)"


def _wanted(t: Tables) -> DataFrame:
    one = lambda a, b: t.rec.select(REC, F.lit(a).cast("bigint").alias("range_onset"), F.lit(b).cast("bigint").alias("range_offset"))
    return one(2 * DAY + 5 * HOUR, 6 * DAY + 3 * HOUR).unionByName(one(9 * DAY, 9 * DAY + HOUR))


@query(f"{_WANTED} SELECT set, i.recording_filename, greatest(range_onset, x) AS range_onset, least(range_offset, y) AS range_offset FROM idx i JOIN want USING (recording_filename) WHERE set IN ('a', 'b') AND range_onset < y AND x < range_offset")
def within_ranges(t: Tables) -> DataFrame:
    return interval.within_ranges(t.idx, _wanted(t), ["a", "b"]).select("set", REC, *RANGE)


@query(f"{_WANTED}, got AS (SELECT set, i.recording_filename, CAST(sum(least(range_offset, y) - greatest(range_onset, x)) AS BIGINT) AS covered FROM idx i JOIN want USING (recording_filename) WHERE range_onset < y AND x < range_offset GROUP BY ALL) SELECT recording_filename, set, requested, coalesce(covered, 0) AS covered FROM (SELECT recording_filename, CAST(sum(y - x) AS BIGINT) AS requested FROM want GROUP BY ALL) CROSS JOIN (SELECT DISTINCT set FROM idx) LEFT JOIN got USING (recording_filename, set)")
def within_ranges_coverage(t: Tables) -> DataFrame:
    return interval.coverage(t.idx, _wanted(t))


def _daily_sql(start: int, stop: int) -> str:
    length = stop - start if stop > start else stop - start + DAY
    hm = lambda c: f"lpad((({c} + begins) % {DAY} // {HOUR})::VARCHAR, 2, '0') || ':' || lpad((({c} + begins) % {HOUR} // 60000)::VARCHAR, 2, '0')"
    return f"w AS (SELECT set, recording_filename, begins, greatest(range_onset, d * {DAY} + {start} - begins) AS range_onset, least(range_offset, d * {DAY} + {start} - begins + {length}) AS range_offset FROM idx JOIN rec USING (recording_filename), (SELECT unnest(range(-1, {adapter.DAYS + 2})) AS d)) SELECT set, recording_filename, range_onset, range_offset, {hm('range_onset')} AS range_onset_time, {hm('range_offset')} AS range_offset_time FROM w WHERE range_offset > range_onset"


@query(_daily_sql(9 * HOUR, 17 * HOUR))
def within_time_range_day(t: Tables) -> DataFrame:
    return clock.within_time_range(t.idx.drop("raw_filename"), t.rec, 9 * HOUR, 17 * HOUR)


@query(_daily_sql(22 * HOUR, 3 * HOUR))
def within_time_range_wrap(t: Tables) -> DataFrame:
    return clock.within_time_range(t.idx.drop("raw_filename"), t.rec, 22 * HOUR, 3 * HOUR)


_SPEECH = "sp AS (SELECT * FROM seg WHERE speaker_type IN ('CHI', 'FEM', 'MAL', 'OCH') AND segment_offset > segment_onset)"


@query(f"""{_SPEECH}, b AS (SELECT recording_filename, segment_onset AS pt FROM sp UNION SELECT recording_filename, segment_offset FROM sp),
p AS (SELECT recording_filename, pt AS x, lead(pt) OVER (PARTITION BY recording_filename ORDER BY pt) AS y FROM b),
o AS (SELECT p.recording_filename, x, y, min(row_no) AS row_no FROM p JOIN sp ON sp.recording_filename = p.recording_filename AND segment_onset <= x AND y <= segment_offset GROUP BY ALL HAVING count(*) = 1)
SELECT row_no, recording_filename, x AS segment_onset, y AS segment_offset FROM o""")
def subtract_others(t: Tables) -> DataFrame:
    return derive.remove_overlaps(t.seg).select("row_no", REC, *SEGMENT)


@query("""s AS (SELECT DISTINCT recording_filename, segment_onset, segment_offset FROM seg WHERE speaker_type = 'CHI' AND segment_offset > segment_onset), e AS (SELECT recording_filename, segment_onset AS x, segment_offset AS y FROM seg WHERE speaker_type = 'FEM' AND segment_offset > segment_onset),
b AS (SELECT recording_filename, segment_onset, segment_offset, segment_onset AS pt FROM s UNION SELECT recording_filename, segment_onset, segment_offset, segment_offset FROM s UNION SELECT s.*, unnest([greatest(x, segment_onset), least(y, segment_offset)]) FROM s JOIN e USING (recording_filename) WHERE segment_onset < y AND x < segment_offset),
p AS (SELECT *, lead(pt) OVER (PARTITION BY recording_filename, segment_onset, segment_offset ORDER BY pt) AS til FROM b),
f AS (SELECT * FROM p WHERE til IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.recording_filename = p.recording_filename AND x <= p.pt AND p.til <= y))
SELECT recording_filename, pt AS segment_onset, til AS segment_offset FROM f""")
def exclude_ranges(t: Tables) -> DataFrame:
    return interval.exclude(t.seg.where("speaker_type = 'CHI'"), t.seg.where("speaker_type = 'FEM'"))


@query("""pos AS (SELECT set, recording_filename, range_onset, range_offset, coalesce(sum(range_offset - range_onset) OVER (PARTITION BY set ORDER BY recording_filename, range_onset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM idx)
SELECT row_no, set, recording_filename, greatest(segment_onset, range_onset) - range_onset + position AS segment_onset, least(segment_offset, range_offset) - range_onset + position AS segment_offset
FROM ann JOIN pos USING (set, recording_filename) WHERE segment_onset < range_offset AND range_onset < segment_offset""")
def collapse_timeline(t: Tables) -> DataFrame:
    cut = interval.range_join(t.ann, t.idx.select("set", REC, *RANGE, F.col("range_onset").alias("_on"), F.col("range_offset").alias("_off")), ["set", REC], SEGMENT, ("_on", "_off"), points=True)
    cut = cut.withColumns({"segment_onset": F.col("overlap_onset"), "segment_offset": F.col("overlap_offset")})
    return interval.collapse(cut, t.idx).select("row_no", "set", REC, *SEGMENT)


@query("""l AS (SELECT recording_filename, segment_onset, segment_offset, min(speaker_type) AS speaker_type FROM seg WHERE row_no % 3 != 0 GROUP BY ALL), r AS (SELECT recording_filename, segment_onset, segment_offset, min(vcm_type) AS vcm_type FROM seg WHERE row_no % 3 != 1 GROUP BY ALL)
SELECT recording_filename, segment_onset, segment_offset, coalesce(speaker_type, 'NA') AS speaker_type, coalesce(vcm_type, 'NA') AS vcm_type, CASE WHEN l.speaker_type IS NULL THEN 'r.csv' WHEN r.vcm_type IS NULL THEN 'l.csv' ELSE 'l.csv,r.csv' END AS raw_filename FROM l FULL JOIN r USING (recording_filename, segment_onset, segment_offset)""")
def merge_sets_outer(t: Tables) -> DataFrame:
    side = lambda keep, c, raw: t.seg.where(keep).groupBy(REC, *SEGMENT).agg(F.min(c).alias(c)).withColumn("raw_filename", F.lit(raw))
    return interval.merge_sets(side("row_no % 3 != 0", "speaker_type", "l.csv"), side("row_no % 3 != 1", "vcm_type", "r.csv"), ["speaker_type"], ["vcm_type"], (REC,))


@query("SELECT set, CAST(sum(range_offset - range_onset) AS BIGINT) AS duration FROM idx GROUP BY set")
def set_durations(t: Tables) -> DataFrame:
    return manage.sets_report(t.idx)


@query(f"{LINE}, f AS (SELECT *, max(segment_offset) OVER w AS before, lead(segment_onset) OVER (PARTITION BY recording_filename ORDER BY segment_onset, segment_offset, l_orderkey, l_linenumber) AS following FROM lin WHERE segment_offset > segment_onset WINDOW w AS (PARTITION BY recording_filename ORDER BY segment_onset, segment_offset, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT recording_filename, count(*) AS n, count(*) FILTER (before > segment_onset OR following < segment_offset) AS overlapping FROM f GROUP BY ALL")
def lineitem_overlaps(t: Tables) -> DataFrame:
    return interval.overlap_flags(t.lines.where("segment_offset > segment_onset")).groupBy(REC).agg(F.count("*").alias("n"), F.count(F.when(F.col("overlaps"), 1)).alias("overlapping"))


# metrics



def _metric_sql(by: str, values: dict[str, str], of: str = "a", more: str = "", rates: tuple[str, ...] = ()) -> str:
    """Aggregates over the clipped segments of a set, joined to the annotated units."""
    child = "" if by == "child_id" else ", child_id"
    dur = f"SELECT {by}{', min(child_id) AS child_id' if child else ''}, CAST(sum(range_offset - range_onset) AS BIGINT) AS d FROM idx JOIN rec USING (recording_filename) WHERE set = '{of}' GROUP BY {by}"
    agg = ", ".join(f"{v} AS {n}" for n, v in values.items())
    counts = ("count", "sum", "coalesce(sum", "cast(sum")
    plain = lambda n, v: f"coalesce({n}, 0)" if v.lower().startswith(counts) else n
    shown = ", ".join(f"round({plain(n, v)} * 3600000.0 / d, 6) AS {n}" if n in rates else f"round({plain(n, v)}, 6) AS {n}" for n, v in values.items())
    return f"""cut AS (SELECT a.* EXCLUDE (segment_onset, segment_offset), child_id, session_id, greatest(segment_onset, range_onset) AS segment_onset, least(segment_offset, range_offset) AS segment_offset, least(segment_offset, range_offset) - greatest(segment_onset, range_onset) AS duration
  FROM ann a JOIN idx i USING (set, recording_filename) JOIN rec USING (recording_filename) WHERE set = '{of}' AND segment_onset < range_offset AND range_onset < segment_offset),
dur AS ({dur}){more}, agg AS (SELECT {by}, {agg} FROM cut GROUP BY {by})
SELECT {by}{child}, d AS duration_{of}, {shown} FROM dur LEFT JOIN agg USING ({by})"""


def _is(who: str, vcm: str | None = None) -> str:
    return f"FILTER (speaker_type = '{who}'" + (f" AND vcm_type = '{vcm}')" if vcm else ")")


def _metrics(t: Tables, specs: list[dict], by: str = REC, of: str = "a", **more) -> DataFrame:
    return extract(t.ann, t.idx, t.rec.select(REC, "child_id", "session_id", "experiment", "start_time", "duration"), [{"set": of} | s for s in specs], by, **more)


def _four(call: str, **more) -> list[dict]:
    return [{"callable": call, "speaker": s, **more} for s in ("CHI", "FEM", "MAL", "OCH")]


@query(_metric_sql(REC, {f"voc_{s.lower()}": f"count(*) {_is(s)}" for s in ("CHI", "FEM", "MAL", "OCH")}))
def voc_speaker(t: Tables) -> DataFrame:
    return _metrics(t, _four("voc_speaker"))


@query(_metric_sql(REC, {f"voc_dur_{s.lower()}": f"sum(duration) {_is(s)}" for s in ("CHI", "FEM", "MAL", "OCH")}))
def voc_dur_speaker(t: Tables) -> DataFrame:
    return _metrics(t, _four("voc_dur_speaker"))


@query(_metric_sql(REC, {f"avg_voc_dur_{s.lower()}": f"avg(duration) {_is(s)}" for s in ("CHI", "FEM")}))
def avg_voc_dur(t: Tables) -> DataFrame:
    return _metrics(t, _four("avg_voc_dur_speaker")[:2])


@query(_metric_sql(REC, {f"std_voc_dur_{s.lower()}": f"stddev_samp(duration) {_is(s)}" for s in ("CHI", "FEM")}))
def std_voc_dur(t: Tables) -> DataFrame:
    return _metrics(t, _four("std_voc_dur_speaker")[:2])


_UNITS = {"wc": "words", "sc": "syllables", "pc": "phonemes"}


@query(_metric_sql("child_id", {f"{u}_fem": f"sum({c}) {_is('FEM')}" for u, c in _UNITS.items()}, "b"))
def wc_sc_pc_speaker(t: Tables) -> DataFrame:
    return _metrics(t, [{"callable": f"{u}_speaker", "speaker": "FEM"} for u in _UNITS], "child_id", "b")


@query(_metric_sql("child_id", {f"{u}_adu_ph": f"sum({c})" for u, c in _UNITS.items()}, rates=tuple(f"{u}_adu_ph" for u in _UNITS)))
def wc_sc_pc_adu(t: Tables) -> DataFrame:
    return _metrics(t, [{"callable": f"{u}_adu_ph"} for u in _UNITS], "child_id")


def _vcm_sql(kind: str, code: str) -> dict[str, str]:
    f = _is("CHI", code)
    return {f"{kind}_voc_chi": f"count(*) {f}", f"{kind}_voc_dur_chi": f"sum(duration) {f}", f"avg_{kind}_voc_dur_chi": f"CASE WHEN count(*) > 0 THEN coalesce(avg(duration) {f}, 0) END", f"std_{kind}_voc_dur_chi": f"stddev_samp(duration) {f}"}


def _vcm(t: Tables, kind: str) -> DataFrame:
    return _metrics(t, [{"callable": f"{p}{kind}_voc{d}_speaker", "speaker": "CHI"} for p, d in (("", ""), ("", "_dur"), ("avg_", "_dur"), ("std_", "_dur"))])


@query(_metric_sql(REC, _vcm_sql("cry", "Y")))
def cry_voc(t: Tables) -> DataFrame:
    return _vcm(t, "cry")


@query(_metric_sql(REC, _vcm_sql("can", "C")))
def can_voc(t: Tables) -> DataFrame:
    return _vcm(t, "can")


@query(_metric_sql(REC, _vcm_sql("non_can", "N")))
def non_can_voc(t: Tables) -> DataFrame:
    return _vcm(t, "non_can")


_CHI = "FILTER (speaker_type = 'CHI')"
_N_CRY, _LEN = "row_no % 3", "child_cry_vfx_len"


@query(_metric_sql(REC, {
    "cry_voc_chi": f"sum({_N_CRY}) {_CHI}",
    "cry_voc_dur_chi": f"sum({_LEN}) {_CHI}",
    "avg_cry_voc_dur_chi": f"CASE WHEN count(*) > 0 THEN coalesce(sum({_LEN}) FILTER (speaker_type = 'CHI' AND {_N_CRY} > 0) / nullif(sum({_N_CRY}) {_CHI}, 0), 0) END",
    "lp_n": f"sum(utterances_count) {_CHI} / nullif(sum(utterances_count + {_N_CRY} + row_no % 2) {_CHI}, 0)",
    "lp_dur": f"(sum(utterances_length) {_CHI}) / nullif(sum(utterances_length + {_LEN}) {_CHI}, 0)",
}).replace("coalesce(lp_n, 0)", "lp_n"))
def cry_voc_array(t: Tables) -> DataFrame:
    specs = [{"callable": c, "speaker": "CHI", "set": "a"} for c in ("cry_voc_speaker", "cry_voc_dur_speaker", "avg_cry_voc_dur_speaker")]
    return extract(t.lists, t.idx, t.rec.select(REC, "child_id"), [*specs, {"callable": "lp_n", "set": "a"}, {"callable": "lp_dur", "set": "a"}])


_NC = "FILTER (speaker_type = 'CHI' AND vcm_type IN ({}))"
_C, _CN, _CNY = (_NC.format(x) for x in ("'C'", "'C', 'N'", "'C', 'N', 'Y'"))


@query(_metric_sql(REC, {"lp_n": f"(count(*) {_CN}) / nullif(count(*) {_CNY}, 0)", "cp_n": f"(count(*) {_C}) / nullif(count(*) {_CN}, 0)"}))
def lp_cp_n(t: Tables) -> DataFrame:
    return _metrics(t, [{"callable": "lp_n"}, {"callable": "cp_n"}])


@query(_metric_sql(REC, {"lp_dur": f"(sum(utterances_length) {_CHI}) / nullif(sum(utterances_length + child_cry_vfx_len) {_CHI}, 0)", "cp_dur": f"(coalesce(sum(duration) {_C}, 0)) / nullif(sum(duration) {_CN}, 0)"}))
def lp_cp_dur(t: Tables) -> DataFrame:
    return _metrics(t, [{"callable": "lp_dur"}, {"callable": "cp_dur"}])


@query(_metric_sql("session_id", {"lena_CVC": "sum(utterances_count)", "lena_CTC": "count(*) FILTER (lena_conv_turn_type IN ('TIMR', 'TIFR'))"}))
def lena_cvc_ctc(t: Tables) -> DataFrame:
    return _metrics(t, [{"callable": "lena_CVC"}, {"callable": "lena_CTC"}], "session_id")


SIX = 6 * HOUR


def _turn_sql(part: str, gap: int = SIX) -> str:
    return f"""(SELECT *, (speaker_type = 'CHI') != (lag(speaker_type) OVER w = 'CHI') AND segment_onset - lag(segment_offset) OVER w < {gap} AND segment_onset - lag(segment_onset) OVER w >= 0 AS turn
  FROM cut WHERE speaker_type IN ('CHI', 'FEM', 'MAL', 'OCH') WINDOW w AS (PARTITION BY {part}recording_filename ORDER BY row_no, segment_onset))"""


@query(_metric_sql("child_id", {"x": "count(*)"}).split(", agg AS")[0] + f", agg AS (SELECT child_id, count(*) FILTER (turn) AS n FROM {_turn_sql('')} GROUP BY child_id) SELECT child_id, d AS duration_a, coalesce(n, 0) AS \"simple_CTC\", round(coalesce(n, 0) * 3600000.0 / d, 6) AS \"simple_CTC_ph\" FROM dur LEFT JOIN agg USING (child_id)")
def simple_ctc(t: Tables) -> DataFrame:
    return _metrics(t, [{"callable": c, "max_interval": SIX} for c in ("simple_CTC", "simple_CTC_ph")], "child_id")


def _peak_sql(value: str, name: str, source: str = "cut", part: str = "b, ") -> str:
    head = _metric_sql(REC, {"x": "count(*)"}).split(", agg AS")[0]
    return f"{head.replace('AS duration', f'AS duration, greatest(segment_onset, range_onset) // {DAY} AS b', 1)}, agg AS (SELECT recording_filename, b, {value} AS v FROM {source} GROUP BY ALL), peak AS (SELECT recording_filename, max(v) AS v FROM agg JOIN dur USING (recording_filename) WHERE b < d // {DAY} GROUP BY ALL) SELECT recording_filename, child_id, d AS duration_a, CASE WHEN d >= {DAY} THEN coalesce(v, 0) END AS \"{name}\" FROM dur LEFT JOIN peak USING (recording_filename)"


@query(_peak_sql(f"count(*) {_is('CHI')}", "peak_voc_chi"))
def peak_voc_speaker(t: Tables) -> DataFrame:
    return _metrics(t, [{"callable": "peak_voc_speaker", "speaker": "CHI", "period_time": DAY}])


@query(_peak_sql("count(*) FILTER (turn)", "peak_simple_CTC", _turn_sql("b, ")))
def peak_simple_ctc(t: Tables) -> DataFrame:
    return _metrics(t, [{"callable": "peak_simple_CTC", "max_interval": SIX, "period_time": DAY}])


_PH = {"voc_chi_ph": f"count(*) {_is('CHI')}", "voc_dur_chi_ph": f"sum(duration) {_is('CHI')}", "cry_voc_chi_ph": f"count(*) {_is('CHI', 'Y')}", "lena_CVC_ph": "sum(utterances_count)"}


def _ph(t: Tables, by: str, **more) -> DataFrame:
    return _metrics(t, [{"callable": f"{c}_speaker_ph", "speaker": "CHI"} for c in ("voc", "voc_dur", "cry_voc")] + [{"callable": "lena_CVC_ph"}], by, **more)


@query(_metric_sql(REC, _PH, rates=tuple(_PH)))
def metrics_per_hour(t: Tables) -> DataFrame:
    return _ph(t, REC)


@query(_metric_sql("child_id", {"voc_fem_ph": f"count(*) {_is('FEM')}", "voc_dur_fem": f"sum(duration) {_is('FEM')}", "avg_voc_dur_fem": f"avg(duration) {_is('FEM')}", "std_voc_dur_fem": f"stddev_samp(duration) {_is('FEM')}"}, rates=("voc_fem_ph",)))
def metrics_by_child(t: Tables) -> DataFrame:
    """The flagship: segments cut to the annotated time, counts, durations and their spread for each child."""
    return _metrics(t, [{"callable": c, "speaker": "FEM"} for c in ("voc_speaker_ph", "voc_dur_speaker", "avg_voc_dur_speaker", "std_voc_dur_speaker")], "child_id")


@query(_metric_sql("session_id", _PH, rates=tuple(_PH)))
def metrics_by_session(t: Tables) -> DataFrame:
    return _ph(t, "session_id")


def _clocked_sql(by: str, pieces: list[tuple[int, int, int, int]], period: bool) -> str:
    """(period start, period end, window start, window length) pieces."""
    hms = lambda c: f"lpad(({c} % {DAY} // {HOUR})::VARCHAR, 2, '0') || ':00:00'"
    key = f"{by}, p" if period else by
    values = ", ".join(map(str, pieces))
    shown = f"{hms('p')} AS period_start, {hms('q')} AS period_end, " if period else ""
    grid = f"(SELECT DISTINCT {by}, {'p, q, ' if period else ''}child_id FROM (SELECT {by}, min(child_id) AS child_id FROM idx JOIN rec USING (recording_filename) WHERE set = 'a' GROUP BY {by}){', win' if period else ''})"
    return f"""win AS (SELECT * FROM (VALUES {values}) v(p, q, s, len)),
base AS (SELECT * FROM (SELECT recording_filename, session_id, p, greatest(range_onset, day * {DAY} + s - begins) AS x, least(range_offset, day * {DAY} + s - begins + len) AS y FROM idx JOIN rec USING (recording_filename), win, (SELECT unnest(range(-1, {adapter.DAYS + 2})) AS day) WHERE set = 'a') WHERE y > x),
dur AS (SELECT {key}, CAST(sum(y - x) AS BIGINT) AS d FROM base GROUP BY {key}),
agg AS (SELECT {key}, count(*) FILTER (speaker_type = 'CHI') AS n, CAST(sum(least(segment_offset, y) - greatest(segment_onset, x)) FILTER (speaker_type = 'CHI') AS BIGINT) AS ms FROM ann JOIN base USING (recording_filename) WHERE set = 'a' AND segment_onset < y AND x < segment_offset GROUP BY {key})
SELECT {by}, child_id, {shown}coalesce(d, 0) AS duration_a, CASE WHEN d > 0 THEN coalesce(n, 0) END AS voc_chi, round(CASE WHEN d > 0 THEN coalesce(ms, 0) * 3600000.0 / d END, 6) AS voc_dur_chi_ph FROM {grid} g LEFT JOIN dur USING ({key}) LEFT JOIN agg USING ({key})"""


def _clocked(t: Tables, by: str, **more) -> DataFrame:
    return _metrics(t, [{"callable": "voc_speaker", "speaker": "CHI"}, {"callable": "voc_dur_speaker_ph", "speaker": "CHI"}], by, **more)


@query(_clocked_sql("recording_filename", [(i * 6 * HOUR, (i + 1) * 6 * HOUR % DAY, i * 6 * HOUR, 6 * HOUR) for i in range(4)], True))
def metrics_by_period(t: Tables) -> DataFrame:
    return _clocked(t, REC, period_ms=6 * HOUR)


@query(_clocked_sql("session_id", [(0, 0, 20 * HOUR, 7 * HOUR)], False))
def metrics_from_to(t: Tables) -> DataFrame:
    return _clocked(t, "session_id", from_time="20:00", to_time="03:00")


@query(f"""un AS (SELECT DISTINCT recording_filename, x, x + {2 * HOUR} AS y FROM (SELECT recording_filename, day * {3 * DAY} + {17 * HOUR} AS x FROM rec, (SELECT unnest(range(0, 10)) AS day))),
base AS (SELECT recording_filename, x, y, greatest(x, range_onset) AS a, least(y, range_offset) AS b FROM un JOIN idx USING (recording_filename) WHERE set = 'a' AND x < range_offset AND range_onset < y),
dur AS (SELECT recording_filename, x, y, CAST(sum(b - a) AS BIGINT) AS d FROM base GROUP BY ALL),
agg AS (SELECT recording_filename, x, y, count(*) FILTER (speaker_type = 'CHI') AS n, CAST(sum(least(segment_offset, b) - greatest(segment_onset, a)) FILTER (speaker_type = 'FEM') AS BIGINT) AS ms FROM ann JOIN base USING (recording_filename) WHERE set = 'a' AND segment_onset < b AND a < segment_offset GROUP BY ALL)
SELECT recording_filename, x AS segment_onset, y AS segment_offset, child_id, coalesce(d, 0) AS duration_a, CASE WHEN d > 0 THEN coalesce(n, 0) END AS voc_chi, CASE WHEN d > 0 THEN coalesce(ms, 0) END AS voc_dur_fem FROM un JOIN rec USING (recording_filename) LEFT JOIN dur USING (recording_filename, x, y) LEFT JOIN agg USING (recording_filename, x, y)""")
def metrics_on_segments(t: Tables) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint")))
    units = t.rec.select(REC, at.alias("day")).select(REC, (F.col("day") * 3 * DAY + 17 * HOUR).alias("segment_onset")).withColumn("segment_offset", F.col("segment_onset") + 2 * HOUR)
    return _metrics(t, [{"callable": "voc_speaker", "speaker": "CHI"}, {"callable": "voc_dur_speaker", "speaker": "FEM"}], "segments", units=units)


@query("""d AS (SELECT child_id, CAST(sum(range_offset - range_onset) AS BIGINT) AS duration_b FROM idx JOIN rec USING (recording_filename) WHERE set = 'b' GROUP BY ALL), c AS (SELECT child_id, count(*) AS n FROM ann a JOIN idx i USING (set, recording_filename) JOIN rec USING (recording_filename) WHERE set = 'b' AND segment_onset < range_offset AND range_onset < segment_offset AND speaker_type = 'MAL' GROUP BY ALL)
SELECT child_id, CASE WHEN count(DISTINCT date_iso) = 1 THEN min(date_iso) END AS date_iso, CASE WHEN count(DISTINCT recording_device_type) = 1 THEN min(recording_device_type) END AS recording_device_type, any_value(child_sex) AS child_sex, any_value(duration_b) AS duration_b, coalesce(any_value(n), 0) AS voc_mal
FROM rec JOIN chi USING (child_id) JOIN d USING (child_id) LEFT JOIN c USING (child_id) GROUP BY child_id""")
def rec_cols_unicity(t: Tables) -> DataFrame:
    return extract(t.ann, t.idx, t.rec, [{"callable": "voc_speaker", "set": "b", "speaker": "MAL"}], "child_id", children=t.chi, rec_cols=("date_iso", "recording_device_type"), child_cols=("child_sex",))


_LENA_SQL = {f"{n}_{s.lower()}{p}": f"{v} {_is(s)}" for n, v, p, who in (("voc", "count(*)", "_ph", "CHI FEM MAL OCH"), ("voc_dur", "sum(duration)", "_ph", "CHI FEM MAL OCH"), ("avg_voc_dur", "avg(duration)", "", "CHI FEM MAL OCH"), ("wc", "sum(words)", "_ph", "FEM MAL")) for s in who.split()} | {"wc_adu_ph": "sum(words)", "lp_n": f"(count(*) {_CN}) / nullif(count(*) {_CNY}, 0)", "lp_dur": f"(coalesce(sum(utterances_length) {_CHI}, 0)) / nullif(coalesce(sum(utterances_length) {_CHI}, 0) + coalesce(sum(child_cry_vfx_len) {_CHI}, 0), 0)", "lena_CVC_ph": "sum(utterances_count)", "lena_CTC_ph": "count(*) FILTER (lena_conv_turn_type IN ('TIMR', 'TIFR'))"}


@query(_metric_sql(REC, _LENA_SQL, rates=tuple(n for n in _LENA_SQL if n.endswith("_ph"))))
def lena_metrics(t: Tables) -> DataFrame:
    return _metrics(t, lena_bundle("a"))


def _aclew_sql() -> str:
    four = ("FEM", "MAL", "CHI", "OCH")
    a = {f"voc_{s.lower()}_ph": f"count(*) {_is(s)}" for s in four} | {f"voc_dur_{s.lower()}_ph": f"sum(duration) {_is(s)}" for s in four} | {f"avg_voc_dur_{s.lower()}": f"avg(duration) {_is(s)}" for s in four}
    b = {f"{u}_{s.lower()}_ph": f"sum({c}) {_is(s)}" for u, c in _UNITS.items() for s in ("FEM", "MAL")} | {f"{u}_adu_ph": f"sum({c})" for u, c in _UNITS.items()}
    rates = tuple(n for n in (*a, *b) if n.endswith("_ph"))
    one = lambda m, s: "WITH " + _metric_sql("child_id", m, s, rates=rates)
    turns = _metric_sql("child_id", {"x": "count(*)"}).split(", agg AS")[0] + f" SELECT child_id, count(*) FILTER (turn) AS n FROM {_turn_sql('', 1000)} GROUP BY child_id"
    return f"va AS ({one(a, 'a')}), vb AS ({one(b, 'b')}), vt AS (WITH {turns}) SELECT va.*, vb.* EXCLUDE (child_id), round(coalesce(n, 0) * 3600000.0 / duration_a, 6) AS \"simple_CTC_ph\" FROM va JOIN vb USING (child_id) LEFT JOIN vt USING (child_id)"


@query(_aclew_sql())
def aclew_metrics(t: Tables) -> DataFrame:
    return extract(t.ann, t.idx, t.rec.select(REC, "child_id"), aclew_bundle("a", "b", None), "child_id")


# conversations

_CONV = """sp AS (SELECT * FROM seg WHERE speaker_type IN ('CHI', 'FEM', 'MAL', 'OCH')),
l AS (SELECT *, segment_onset - lag(segment_offset) OVER w AS iti, lag(speaker_type) OVER w AS prev_speaker_type, segment_onset - lag(segment_onset) OVER w AS delay FROM sp WINDOW w AS (PARTITION BY recording_filename ORDER BY row_no)),
c AS (SELECT *, coalesce(iti < 21600000 AND delay >= 0 AND prev_speaker_type IS NOT NULL, false) AS is_ct FROM l),
s AS (SELECT *, NOT is_ct AND coalesce(lead(is_ct) OVER (PARTITION BY recording_filename ORDER BY row_no), false) AS starts FROM c),
cv AS (SELECT * EXCLUDE (starts), CASE WHEN is_ct OR starts THEN CAST(sum(starts::INT) OVER (PARTITION BY recording_filename ORDER BY row_no) AS BIGINT) END AS conv_count FROM s)"""


def _conv(t: Tables) -> DataFrame:
    return conversations.conversation_ids(t.seg, max_interval=SIX)


@query("cut AS (SELECT * FROM seg) SELECT row_no, recording_filename, coalesce(turn, false) AS is_turn FROM " + _turn_sql(""))
def turns(t: Tables) -> DataFrame:
    return turn_flags(t.seg, [REC], max_interval=SIX).where(F.col("speaker_type").isin("CHI", "FEM", "MAL", "OCH")).select("row_no", REC, "is_turn")


@query(f'{_CONV} SELECT row_no, recording_filename, iti, prev_speaker_type, delay, is_ct AS "is_CT", conv_count FROM cv')
def conversation_ids(t: Tables) -> DataFrame:
    return _conv(t).select("row_no", REC, "iti", "prev_speaker_type", "delay", "is_CT", "conv_count")


_SUM = f"{_CONV}, g AS (SELECT recording_filename, conv_count, arg_min(segment_onset, row_no) AS conversation_onset, max(segment_offset) AS conversation_offset, count(*) AS voc_count, arg_max(segment_offset, row_no) AS last FROM cv WHERE conv_count IS NOT NULL GROUP BY ALL), gg AS (SELECT recording_filename, conv_count, conversation_onset, conversation_offset, voc_count, conversation_onset - lag(last) OVER (PARTITION BY recording_filename ORDER BY conv_count) AS interval_last_conv FROM g)"
_KEYS = "recording_filename, conv_count"


@query(f"{_SUM}, f AS (SELECT {_KEYS}, arg_min(speaker_type, row_no) AS initiator, arg_max(speaker_type, (segment_offset, -row_no)) AS finisher, CAST(sum(segment_offset - segment_onset) AS BIGINT) AS total_duration_of_vocalisations, " + ", ".join(f"count(*) {_is(s)} AS \"{s}_voc_count\", CAST(sum(segment_offset - segment_onset) {_is(s)} AS BIGINT) AS \"{s}_voc_dur\"" for s in ("CHI", "FEM", "MAL", "OCH")) + f" FROM cv WHERE conv_count IS NOT NULL GROUP BY ALL) SELECT * FROM gg JOIN f USING ({_KEYS})")
def conversation_summary(t: Tables) -> DataFrame:
    return conversations.summarise(_conv(t))


@query(f"{_SUM} SELECT {_KEYS}, child_id, date_iso, child_sex, interval_last_conv FROM gg JOIN rec USING (recording_filename) JOIN chi USING (child_id)")
def conversation_gap(t: Tables) -> DataFrame:
    return conversations.with_metadata(conversations.summarise(_conv(t), []), t.rec, t.chi, ("date_iso",), ("child_sex",)).select(REC, "conv_count", "child_id", "date_iso", "child_sex", "interval_last_conv")


def _feature(t: Tables, *calls: str) -> DataFrame:
    df = _conv(t)
    specs = [{"callable": c, "name": c, **({"speaker": "CHI"} if c in ("is_speaker", "voc_dur_contribution", "voc_speaker_dur") else {})} for c in calls]
    return conversations.summarise(df, specs).select(REC, "conv_count", *calls)


@query(f"{_CONV} SELECT {_KEYS}, arg_min(speaker_type, row_no) AS who_initiated FROM cv WHERE conv_count IS NOT NULL GROUP BY ALL")
def who_initiated(t: Tables) -> DataFrame:
    return _feature(t, "who_initiated")


@query(f"{_CONV} SELECT {_KEYS}, arg_max(speaker_type, (segment_offset, -row_no)) AS who_finished FROM cv WHERE conv_count IS NOT NULL GROUP BY ALL")
def who_finished(t: Tables) -> DataFrame:
    return _feature(t, "who_finished")


@query(f"{_CONV}, f AS (SELECT {_KEYS}, speaker_type, min(row_no) AS n FROM cv WHERE conv_count IS NOT NULL GROUP BY ALL) SELECT {_KEYS}, string_agg(speaker_type, '/' ORDER BY n) AS participants FROM f GROUP BY ALL")
def participants(t: Tables) -> DataFrame:
    return _feature(t, "participants")


@query(f"{_CONV} SELECT {_KEYS}, bool_or(speaker_type = 'CHI') AS is_speaker, CAST(sum(segment_offset - segment_onset) {_is('CHI')} AS BIGINT) AS voc_speaker_dur, round((sum(segment_offset - segment_onset) {_is('CHI')}) / nullif(sum(segment_offset - segment_onset), 0), 6) AS voc_dur_contribution FROM cv WHERE conv_count IS NOT NULL GROUP BY ALL")
def voc_contribution(t: Tables) -> DataFrame:
    return _feature(t, "is_speaker", "voc_speaker_dur", "voc_dur_contribution")


@query(f"{_CONV}, h AS (SELECT {_KEYS}, bool_or(speaker_type = 'CHI') AS c, bool_or(speaker_type = 'FEM')::INT AS f, bool_or(speaker_type = 'MAL')::INT AS m, bool_or(speaker_type = 'OCH')::INT AS o FROM cv WHERE conv_count IS NOT NULL GROUP BY ALL) SELECT {_KEYS}, CASE WHEN NOT c THEN 'overheard' ELSE ([NULL, 'dyadic_FEM', 'dyadic_MAL', 'parent', 'peer', 'triadic_FEM', 'triadic_MAL', 'multiparty'])[1 + f + 2 * m + 4 * o] END AS assign_conv_type FROM h")
def conv_type(t: Tables) -> DataFrame:
    return _feature(t, "assign_conv_type")


_NEAR = "n AS (SELECT *, lag(speaker_type) OVER w AS p, lead(speaker_type) OVER w AS q, segment_onset - lag(segment_offset) OVER w AS b, lead(segment_onset) OVER w - segment_offset AS a FROM seg WINDOW w AS (PARTITION BY recording_filename ORDER BY row_no))"


@query(f"{_NEAR} SELECT row_no, CASE WHEN speaker_type = 'CHI' THEN 'C' ELSE 'O' END AS speaker_class, CASE WHEN speaker_type = 'CHI' THEN 'NA' WHEN (p = 'CHI' AND b <= {SIX}) OR (q = 'CHI' AND a <= {SIX}) THEN 'Y' ELSE 'N' END AS cva FROM n")
def cva_restrictive(t: Tables) -> DataFrame:
    return derive.cva(t.seg, "R", SIX).select("row_no", "speaker_class", "cva")


@query(f"{_NEAR} SELECT row_no, CASE WHEN speaker_type = 'CHI' THEN 'C' ELSE 'O' END AS speaker_class, CASE WHEN speaker_type = 'CHI' THEN 'NA' WHEN p = 'CHI' OR q = 'CHI' THEN 'Y' WHEN abs(b) <= {SIX} AND (abs(a) > {SIX} OR a IS NULL OR abs(b) < abs(a)) THEN CASE WHEN p = speaker_type THEN 'Y' ELSE 'N' END WHEN abs(a) <= {SIX} THEN CASE WHEN q = speaker_type THEN 'Y' ELSE 'N' END ELSE 'Y' END AS cva FROM n")
def cva_permissive(t: Tables) -> DataFrame:
    return derive.cva(t.seg, "P", SIX).select("row_no", "speaker_class", "cva")


# samplers

_SLOT = "SELECT recording_filename, greatest(slot - f, 0) AS segment_onset, least(slot + 3600000 - f, duration) AS segment_offset FROM {r} WHERE slot < f + duration AND slot + 3600000 > f"


@query(f"r AS (SELECT recording_filename, duration, 0 AS f, unnest(range(1800000, duration, {7 * HOUR})) AS slot FROM rec) {_SLOT.format(r='r')}")
def periodic_recording(t: Tables) -> DataFrame:
    return sampling.periodic(t.rec, HOUR, 6 * HOUR, HOUR // 2)


@query(f"z AS (SELECT *, epoch_us(date_iso::TIMESTAMP) // 1000 + begins AS f FROM rec), g AS (SELECT session_id, unnest(range(min(f)::BIGINT, max(f + duration)::BIGINT, {30 * HOUR})) AS slot FROM z GROUP BY session_id), r AS (SELECT * FROM z JOIN g USING (session_id)) {_SLOT.format(r='r')}")
def periodic_session(t: Tables) -> DataFrame:
    start = F.unix_millis(F.to_timestamp(F.concat_ws(" ", "date_iso", "start_time"), "yyyy-MM-dd HH:mm"))
    return sampling.periodic(t.rec.withColumn("start_ts", start), HOUR, 29 * HOUR, 0, "session_id")


def _top_sql(score: str, where: str, source: str = "seg", k: int = 3) -> str:
    return f"h AS (SELECT recording_filename, segment_offset // {DAY} + 1 AS c, min(segment_onset) AS segment_onset, max(segment_offset) AS segment_offset, {score} AS score FROM {source} GROUP BY ALL HAVING count(*) FILTER ({where}) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY recording_filename ORDER BY score DESC, segment_onset) AS nth FROM h) SELECT recording_filename, segment_onset, segment_offset FROM k WHERE nth <= {k}"


_WHO = "speaker_type IN ('FEM', 'MAL', 'CHI', 'OCH')"


@query(_top_sql("sum(words) FILTER (speaker_type = 'FEM')", "speaker_type = 'FEM'"))
def high_volubility_words(t: Tables) -> DataFrame:
    return sampling.high_volubility(t.seg, "words", DAY, 3, ("FEM",))


@query(_top_sql(f"count(*) FILTER ({_WHO} AND lena_conv_turn_type IN ('TIFR', 'TIMR'))", _WHO))
def high_volubility_turns(t: Tables) -> DataFrame:
    return sampling.high_volubility(t.seg, "turns", DAY, 3)


@query(_top_sql(f"sum(utterances_count) FILTER ({_WHO})", _WHO))
def high_volubility_vocs(t: Tables) -> DataFrame:
    return sampling.high_volubility(t.seg, "vocs", DAY, 3)


@query("""w AS (SELECT *, segment_onset - lag(segment_offset) OVER w > 7200000 AS brk, coalesce((speaker_type = 'CHI') != lag(speaker_type = 'CHI') OVER w, false) AS sw, row_number() OVER w AS n FROM seg WHERE speaker_type IN ('FEM', 'MAL', 'CHI') WINDOW w AS (PARTITION BY recording_filename ORDER BY segment_onset, segment_offset, row_no)),
x AS (SELECT *, sum(coalesce(brk, false)::INT) OVER (PARTITION BY recording_filename ORDER BY n) AS chain FROM w),
h AS (SELECT recording_filename, chain, arg_min(segment_onset, n) AS segment_onset, arg_max(segment_offset, n) AS segment_offset, count(*) FILTER (sw) AS turns FROM x GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY recording_filename ORDER BY turns DESC, segment_onset) AS nth FROM h) SELECT recording_filename, segment_onset, segment_offset FROM k WHERE nth <= 5""")
def conversation_topk(t: Tables) -> DataFrame:
    return sampling.top_conversations(t.seg, 5, 2 * HOUR)


@query("q AS (SELECT recording_filename, quantile_cont(words + phonemes / 100, 0.8) AS least FROM seg GROUP BY ALL) SELECT row_no, recording_filename, round(words + phonemes / 100, 6) AS energy FROM seg JOIN q USING (recording_filename) WHERE words + phonemes / 100 >= least - 1e-12")
def energy_quantile(t: Tables) -> DataFrame:
    return sampling.above_quantile(t.seg.select("row_no", REC, (F.col("words") + F.col("phonemes") / 100).alias("energy")), 0.8)


@query("SELECT recording_filename, segment_onset, segment_offset FROM (SELECT *, row_number() OVER (PARTITION BY recording_filename ORDER BY md5('7|' || recording_filename || '|' || segment_onset || '|' || segment_offset || '|' || row_no), segment_onset, segment_offset) AS nth FROM seg WHERE speaker_type IN ('CHI', 'OCH')) WHERE nth <= 5")
def random_vocalizations(t: Tables) -> DataFrame:
    return sampling.random_vocalizations(t.seg, 5, ("CHI", "OCH"), seed=7)


@query("p AS (SELECT row_no, segment_onset, segment_offset, greatest(ceil((segment_offset - segment_onset) / 500000.0)::BIGINT, 1) * 500000 AS target FROM seg), z AS (SELECT *, trunc(segment_onset - (target - (segment_offset - segment_onset)) / 2.0)::BIGINT AS lo FROM p) SELECT row_no, lo + i * 500000 AS onset, lo + (i + 1) * 500000 AS offset FROM z, LATERAL (SELECT unnest(range(0, target // 500000)) AS i) u WHERE lo >= 0")
def chunk_padding(t: Tables) -> DataFrame:
    return sampling.chunks(t.seg, 500_000).select("row_no", "onset", "offset")


# reliability: annotators a and b label each recording from end to end; the SQL lays all frames out, as the engine does not

_CATS = ("CHI", "FEM", "MAL", "OCH")
_FRAME = 60_000
_GRID = f"""src AS (SELECT 'a' AS coder, recording_filename, segment_onset, segment_offset, speaker_type FROM seg UNION ALL SELECT 'b', recording_filename, segment_onset + 30000, segment_offset, CASE WHEN row_no % 5 = 0 THEN 'FEM' ELSE speaker_type END FROM seg),
len AS (SELECT recording_filename, ceil(duration / {_FRAME}.0)::BIGINT AS frames FROM rec),
fr AS (SELECT DISTINCT coder, recording_filename, unnest(range(segment_onset // {_FRAME}, least(segment_offset // {_FRAME}, frames))) AS frame, speaker_type AS category FROM src JOIN len USING (recording_filename) WHERE speaker_type != 'NA'),
ev AS (SELECT coder, recording_filename, unnest(range(0, frames)) AS frame FROM (VALUES ('a'), ('b')) c(coder), len),
grid AS (SELECT * FROM fr UNION ALL SELECT coder, recording_filename, frame, 'none' FROM (SELECT * FROM ev ANTI JOIN fr USING (coder, recording_filename, frame))),
lab AS (SELECT coder, recording_filename, frame, coalesce(arg_max(category, list_position(['CHI','FEM','MAL','OCH','none'], category)), 'none') AS label FROM grid GROUP BY ALL)"""


def _grid(t: Tables) -> DataFrame:
    b = t.seg.withColumns({"segment_onset": F.col("segment_onset") + 30_000, "speaker_type": F.when(F.col("row_no") % 5 == 0, "FEM").otherwise(F.col("speaker_type"))})
    both = t.seg.withColumn("set", F.lit("a")).unionByName(b.withColumn("set", F.lit("b")))
    ranges = t.rec.select(REC, F.lit(0).cast("bigint").alias("range_onset"), F.col("duration").cast("bigint").alias("range_offset"))
    return reliability.frames(both, ranges, _FRAME, _CATS, coders=("a", "b"))


def _labels(t: Tables) -> DataFrame:
    return reliability.labels(_grid(t), (*_CATS, "none"))


@query(f"{_GRID} SELECT recording_filename, coder, category, count(*) AS frames FROM grid GROUP BY ALL")
def frame_grid(t: Tables) -> DataFrame:
    return _grid(t).groupBy(REC, "coder", "category").agg(F.sum("n").alias("frames"))


@query(f"{_GRID} SELECT recording_filename, coder, label, count(*) AS frames FROM lab GROUP BY ALL")
def frame_labels(t: Tables) -> DataFrame:
    return _labels(t).groupBy(REC, "coder", "label").agg(F.sum("n").alias("frames"))


@query(f"{_GRID} SELECT a.category AS category_1, b.category AS category_2, count(*) AS n FROM grid a JOIN grid b USING (recording_filename, frame) WHERE a.coder = 'a' AND b.coder = 'b' GROUP BY ALL")
def confusion_matrix(t: Tables) -> DataFrame:
    return reliability.confusion(_grid(t), "a", "b")


@query(f"{_GRID}, pr AS (SELECT count(*) AS n, count(*) FILTER (x.label != y.label) AS diff FROM lab x JOIN lab y USING (recording_filename, frame) WHERE x.coder = 'a' AND y.coder = 'b'), tot AS (SELECT sum(t::DOUBLE * t) AS same FROM (SELECT label, count(*) AS t FROM lab GROUP BY label)) SELECT round(1 - (diff / n) / ((4.0 * n * n - same) / (2.0 * n * (2.0 * n - 1))), 6) AS alpha, 2 * n AS n_pairable, round(diff / n, 6) AS observed, round((4.0 * n * n - same) / (2.0 * n * (2.0 * n - 1)), 6) AS expected FROM pr, tot")
def krippendorff_alpha(t: Tables) -> DataFrame:
    return reliability.krippendorff_alpha(_labels(t))


@query(f"{_GRID}, pr AS (SELECT x.label AS la, y.label AS lb FROM lab x JOIN lab y USING (recording_filename, frame) WHERE x.coder = 'a' AND y.coder = 'b'), ao AS (SELECT avg((la = lb)::INT) AS ao, count(*) AS n FROM pr), ae AS (SELECT sum(p * q) AS ae FROM (SELECT la AS l, count(*)::DOUBLE AS p FROM pr GROUP BY la) JOIN (SELECT lb AS l, count(*)::DOUBLE AS q FROM pr GROUP BY lb) USING (l)) SELECT round((ao - ae / n / n) / (1 - ae / n / n), 6) AS kappa, round(ao, 6) AS agreement, round(ae / n / n, 6) AS chance FROM ao, ae")
def multi_kappa(t: Tables) -> DataFrame:
    return reliability.multi_kappa(_labels(t), ["a", "b"])


@query(f"{_GRID}, ra AS (SELECT recording_filename, frame, count(*) AS r, list(category) AS rc FROM fr WHERE coder = 'a' GROUP BY ALL), hb AS (SELECT recording_filename, frame, count(*) AS h, list(category) AS hc FROM fr WHERE coder = 'b' GROUP BY ALL), p AS (SELECT coalesce(r, 0) AS r, coalesce(h, 0) AS h, coalesce(len(list_intersect(rc, hc)), 0) AS c FROM ra FULL JOIN hb USING (recording_filename, frame)), s AS (SELECT CAST(sum(r) AS BIGINT) AS reference, CAST(sum(greatest(r - h, 0)) AS BIGINT) AS missed, CAST(sum(greatest(h - r, 0)) AS BIGINT) AS false_alarm, CAST(sum(least(r, h) - c) AS BIGINT) AS confused FROM p) SELECT *, round((missed + false_alarm) / reference, 6) AS detection_error_rate, round((missed + false_alarm + confused) / reference, 6) AS identification_error_rate FROM s")
def error_rates(t: Tables) -> DataFrame:
    return reliability.error_rates(_grid(t), "a", "b")


# validation and management


@query("SELECT 'event_type' AS \"column\", event_id AS line, event_type AS value, 'invalid' AS problem, 'error' AS severity FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')")
def choices_violations(t: Tables) -> DataFrame:
    return validate.violations(t.read("events"), [Rule("event_type", True, choices=("click", "view", "purchase", "signup"))], "event_id")


@query("SELECT 'c_name' AS \"column\", c_custkey AS line, c_name AS value, 'invalid' AS problem, 'warning' AS severity FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#\\d*[02468]')")
def regex_violations(t: Tables) -> DataFrame:
    return validate.violations(t.read("customer"), [Rule("c_name", regex=r"Customer#\d*[02468]")], "c_custkey")


@query("SELECT 'normative' AS \"column\", child_id AS line, NULL::VARCHAR AS value, 'null' AS problem, 'error' AS severity FROM chi WHERE normative IS NULL UNION ALL SELECT 'mother_id', NULL, NULL, 'missing column', 'error'")
def required_nulls(t: Tables) -> DataFrame:
    return validate.violations(t.chi, [Rule("normative", True), Rule("mother_id", True)], "child_id")


@query("SELECT child_id, session_id, count(*) AS n, string_agg(u, ',' ORDER BY u) AS lines FROM (SELECT *, substr(recording_filename, 4)::BIGINT AS u FROM rec) GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return validate.duplicates(t.rec.withColumn("_line", F.substring(REC, 4, 20)), ["child_id", "session_id"])


@query("SELECT row_no, segment_onset AS range_onset, segment_offset AS range_offset FROM (SELECT row_no, segment_onset - 3600000 AS segment_onset, segment_offset - row_no % 7 * 400000 AS segment_offset FROM seg) WHERE segment_offset <= segment_onset OR segment_onset < 0")
def range_errors(t: Tables) -> DataFrame:
    return validate.range_errors(t.seg.select("row_no", (F.col("segment_onset") - HOUR).alias("range_onset"), (F.col("segment_offset") - F.col("row_no") % 7 * 400_000).alias("range_offset")))


@query("SELECT set, recording_filename, range_onset, range_offset, duration AS recording_duration FROM idx JOIN rec USING (recording_filename) WHERE range_offset > duration")
def duration_overflow(t: Tables) -> DataFrame:
    return validate.duration_overflow(t.idx, t.rec).select("set", REC, *RANGE, "recording_duration")


@query("SELECT row_no, 'a' AS set, recording_filename FROM (SELECT row_no, recording_filename, segment_onset, segment_offset FROM seg) x WHERE EXISTS (SELECT 1 FROM seg b WHERE b.recording_filename = x.recording_filename AND b.row_no != x.row_no AND x.segment_onset < b.segment_offset AND b.segment_onset < x.segment_offset)")
def overlapping_ranges(t: Tables) -> DataFrame:
    rows = t.seg.select("row_no", F.lit("a").alias("set"), REC, F.col("segment_onset").alias("range_onset"), F.col("segment_offset").alias("range_offset"))
    return validate.overlapping_ranges(rows).select("row_no", "set", REC)


@query("SELECT recording_filename, child_id FROM rec WHERE child_id NOT IN (SELECT child_id FROM chi WHERE child_id % 5 != 0)")
def orphan_recordings(t: Tables) -> DataFrame:
    return validate.orphans(t.rec, t.chi.where("child_id % 5 != 0"), ["child_id"]).select(REC, "child_id")


@query("SELECT recording_filename, child_id, date_iso, dob AS child_dob FROM (SELECT *, replace(child_dob, '2022', '2024') AS dob FROM rec JOIN chi USING (child_id)) WHERE date_iso::DATE < dob::DATE")
def negative_ages(t: Tables) -> DataFrame:
    return validate.negative_ages(t.rec, t.chi.withColumn("child_dob", F.regexp_replace("child_dob", "2022", "2024")))


_IMPORTED = "im AS (SELECT DISTINCT o_orderpriority AS set, 'rec' || o_custkey AS recording_filename, 0 AS range_onset, strftime(o_orderdate, '%Y-%m-%d') AS imported_at, CASE WHEN o_orderpriority LIKE '1%' THEN '2-HIGH,3-MEDIUM,6-OTHER' END AS merged_from FROM orders)"


def _imported(t: Tables) -> DataFrame:
    o = t.read("orders")
    return o.select(F.col("o_orderpriority").alias("set"), F.concat(F.lit("rec"), F.col("o_custkey").cast("string")).alias(REC), F.lit(0).cast("bigint").alias("range_onset"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("imported_at"), F.when(F.col("o_orderpriority").startswith("1"), "2-HIGH,3-MEDIUM,6-OTHER").alias("merged_from")).distinct()


@query(f"{_IMPORTED}, la AS (SELECT set, max(imported_at) AS la_at FROM im GROUP BY set), me AS (SELECT set, max(imported_at) AS merged_at, unnest(string_split(any_value(merged_from), ',')) AS source FROM im WHERE merged_from IS NOT NULL GROUP BY set) SELECT me.set, source, CASE WHEN la_at IS NULL THEN 'gone' ELSE 'imported later' END AS reason FROM me LEFT JOIN la ON la.set = me.source WHERE la_at IS NULL OR la_at > merged_at")
def outdated_merges(t: Tables) -> DataFrame:
    return validate.outdated_merges(_imported(t))


@query(f"{_IMPORTED} SELECT set, recording_filename, range_onset, max(imported_at) AS imported_at FROM im GROUP BY ALL")
def import_keep_last(t: Tables) -> DataFrame:
    return manage.keep_last(_imported(t), ("set", REC, "range_onset")).select("set", REC, "range_onset", "imported_at")


@query(f"{_IMPORTED} SELECT CASE WHEN set = '2-HIGH' THEN 'high' ELSE set END AS set, CASE WHEN merged_from IS NOT NULL THEN 'high,3-MEDIUM,6-OTHER' END AS merged_from, count(*) AS n FROM im GROUP BY ALL")
def rename_merged_from(t: Tables) -> DataFrame:
    return manage.rename_set(_imported(t), "2-HIGH", "high").groupBy("set", "merged_from").agg(F.count("*").alias("n"))


@query("r AS (SELECT count(*) AS recordings, count(DISTINCT child_id) AS recorded_children, CAST(sum(duration) AS BIGINT) AS total_duration, min(date_iso) AS first_date, max(date_iso) AS last_date, min(date_diff('day', child_dob::DATE, date_iso::DATE)) AS least_age_days, max(date_diff('day', child_dob::DATE, date_iso::DATE)) AS greatest_age_days FROM rec JOIN chi USING (child_id)), c AS (SELECT count(*) AS children, count(*) FILTER (child_sex = 'm') AS boys, count(*) FILTER (child_sex = 'f') AS girls, count(*) FILTER (monoling = 'Y') AS monolingual, count(*) FILTER (monoling = 'N') AS multilingual, count(*) FILTER (normative = 'Y') AS normative FROM chi) SELECT * FROM r, c")
def dataset_overview(t: Tables) -> DataFrame:
    return manage.overview(t.rec, t.chi).withColumns({c: F.col(c).cast("bigint") for c in ("least_age_days", "greatest_age_days")})


@query("SELECT recording_device_type, count(*) AS recordings, CAST(sum(duration) AS BIGINT) AS duration FROM rec GROUP BY ALL")
def device_breakdown(t: Tables) -> DataFrame:
    return manage.devices(t.rec)


@query("SELECT trim(l) AS language, count(DISTINCT child_id) AS children FROM (SELECT child_id, unnest(string_split(languages, ';')) AS l FROM chi) GROUP BY ALL")
def language_explode(t: Tables) -> DataFrame:
    return manage.languages(t.chi)


@query("SELECT l_orderkey AS id, l_suppkey AS user_id, l_partkey AS subject_id, 'T' || l_linenumber AS task_id, l_returnflag AS answer_id, 'answer ' || l_returnflag AS answer, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag != 'N' AND l_linenumber <= 2")
def classifications_join(t: Tables) -> DataFrame:
    raw = t.read("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("subject_id"), F.lit(1).alias("workflow_id"), F.array(F.struct(F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("task"), F.col("l_returnflag").alias("value"))).alias("annotations"))
    answers = t.spark.createDataFrame([(1, f"T{i}", a, f"answer {a}") for i in (1, 2) for a in "AR"], "workflow_id int, task_id string, answer_id string, answer string")
    chunks = t.read("part").select(F.col("p_partkey").alias("subject_id"), "p_brand")
    return manage.classifications(raw, answers, chunks).select("id", "user_id", "subject_id", "task_id", "answer_id", "answer", "p_brand")


@query("""w AS (SELECT row_no, conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT *, turn AS row_no FROM conversations))
SELECT conv_id, count(*) AS turns, count(*) FILTER (prev != role AND 'user' IN (prev, role)) AS switches, arg_min(role, turn) AS initiator, arg_max(role, turn) AS finisher FROM w GROUP BY ALL""")
def dialogue_turns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    prev = F.lag("role").over(w)
    rows = t.read("conversations").select("conv_id", "turn", "role").withColumn("s", (prev != F.col("role")) & ((prev == "user") | (F.col("role") == "user")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count(F.when(F.col("s"), 1)).alias("switches"), F.min_by("role", "turn").alias("initiator"), F.max_by("role", "turn").alias("finisher"))


@query("SELECT recording_filename, code_num, code_onset, code_offset, greatest(code_onset - 60000, 0) AS context_onset, code_offset + 60000 AS context_offset FROM (SELECT recording_filename, row_number() OVER (PARTITION BY recording_filename ORDER BY segment_onset, segment_offset) AS code_num, segment_onset AS code_onset, segment_offset AS code_offset FROM (SELECT DISTINCT recording_filename, segment_onset, segment_offset FROM seg))")
def annotation_templates(t: Tables) -> DataFrame:
    from earshot.sources.tables import eaf_templates

    return eaf_templates(t.seg.select(REC, *SEGMENT).distinct(), 60_000).withColumn("code_num", F.col("code_num").cast("bigint"))
