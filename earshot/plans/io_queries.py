"""Registered queries of sources, sinks, audio and bookkeeping: the synthetic tables are written in each format to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.clock import HOUR, circular_intersect
from earshot.operators import audio, derive, reliability, sampling, validate
from earshot.operators.interval import RANGE, REC, SEGMENT
from earshot.plans import manage
from earshot.plans.queries import _FRAME, _GRID, QUERIES, SQLS, Tables, _grid, query
from earshot.schema import RECORDINGS, Rule
from earshot.sources import formats, tables
from earshot.sources.audio import durations, read_wav, write_wav
from earshot.storage import shared_folder

__all__ = ["QUERIES", "SQLS"]


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/formats-{uuid.uuid4().hex}"


def _lines(t: Tables, df: DataFrame, *parts: Column | str) -> str:
    """A folder of text files with a line for each row."""
    folder = _folder(t)
    df.select(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")).write.text(folder)
    return folder


#: Folders over which the files of a table are spread, each listed by a task of its own.
FOLDERS = 256


def _spread(name: Column) -> Column:
    """A file's name, below one of FOLDERS folders."""
    return F.concat(F.lpad(F.hex(F.crc32(name.cast("binary")) % FOLDERS), 2, "0"), F.lit("/"), name)


def _documents(t: Tables, fmt: str, head: str, line: Column, tail: str) -> str:
    """A document for each recording, with a line for each of its segments in their order."""
    folder = _folder(t)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))), lambda r: r["line"]), "\n")
    name = _spread(F.concat(F.col(REC), F.lit("." + formats.EXTENSIONS[fmt])))
    formats.write_documents(t.seg.groupBy(REC).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value")).select(name.alias("name"), "value"), folder).count()
    return f"{folder}/*"


def _seconds(c: str) -> Column:
    return F.format_string("%.3f", F.col(c) / 1000)


# tables


@query("SELECT recording_filename, child_id::VARCHAR AS child_id, duration, date_iso, start_time, discard FROM rec")
def scan_typed_table(t: Tables) -> DataFrame:
    path = _folder(t)
    t.rec.write.csv(path, header=True)
    out = tables.read_table(t.spark, path, RECORDINGS)
    return out.select(REC, F.col("child_id").cast("string").alias("child_id"), F.col("duration").cast("bigint").alias("duration"), "date_iso", "start_time", F.col("discard").cast("string").alias("discard"))


@query("SELECT recording_filename, CASE WHEN discard = '1' THEN NULL ELSE discard END AS discard, duration::VARCHAR AS duration FROM rec")
def scan_untyped_table(t: Tables) -> DataFrame:
    """Text columns, with the spellings of null."""
    path = _folder(t)
    t.rec.withColumn("discard", F.when(F.col("discard") == "1", "").otherwise(F.col("discard"))).write.csv(path, header=True)
    return tables.read_table(t.spark, path).select(REC, "discard", "duration")


@query("SELECT 'children' AS \"table\", r_name AS variable FROM region UNION ALL SELECT 'recordings', n_name FROM nation UNION ALL SELECT 'annotations', s_name FROM supplier")
def scan_documentation(t: Tables) -> DataFrame:
    root = _folder(t)
    for name, table, column in (("children", "region", "r_name"), ("recordings", "nation", "n_name"), ("annotations", "supplier", "s_name")):
        t.read(table).select(F.col(column).alias("variable"), F.lit("of it").alias("description")).write.csv(f"{root}/docs/{name}.csv", header=True)
    return tables.read_documentation(t.spark, root).select("table", "variable")


@query("SELECT set, recording_filename, range_onset, range_offset, recording_filename || '_' || range_onset || '_' || range_offset || '.csv' AS annotation_filename FROM idx")
def index_sink(t: Tables) -> DataFrame:
    """Rows imported twice are written once, the later ones."""
    path = _folder(t)
    rows = t.idx.drop("raw_filename")
    tables.write_index(rows.withColumn("imported_at", F.lit("1")).unionByName(rows.withColumn("imported_at", F.lit("2"))), path)
    return t.spark.read.parquet(path).where("imported_at = '2'").select("set", REC, *RANGE, "annotation_filename")


@query("SELECT set, row_no, recording_filename, segment_onset, segment_offset, speaker_type, words FROM ann WHERE set = 'b'")
def segments_sink(t: Tables) -> DataFrame:
    """A folder for each set; one is read."""
    path = _folder(t)
    tables.write_segments(t.ann, path)
    return t.spark.read.parquet(path).where("set = 'b'").select("set", "row_no", REC, *SEGMENT, "speaker_type", "words")


@query("SELECT recording_filename, duration::VARCHAR AS duration, CASE WHEN discard = '1' THEN '1' ELSE discard END AS discard FROM rec")
def recordings_sink(t: Tables) -> DataFrame:
    path = _folder(t)
    tables.write_recordings(*manage.split_discarded(t.rec), path)
    return t.spark.read.csv(path, header=True).select(REC, "duration", "discard")


# formats


@query("SELECT segment_onset, segment_offset, CASE WHEN speaker_type != 'NA' THEN speaker_type END AS speaker_type, words::VARCHAR AS words FROM seg")
def reader_csv(t: Tables) -> DataFrame:
    path = _folder(t)
    t.seg.select(*SEGMENT, "speaker_type", "words").write.csv(path, header=True)
    return formats.read(t.spark, "csv", path).select(*SEGMENT, "speaker_type", "words")


@query("SELECT segment_onset, segment_offset, CASE speaker_type WHEN 'CHI' THEN 'OCH' ELSE speaker_type END AS speaker_type FROM seg")
def reader_vtc_rttm(t: Tables) -> DataFrame:
    path = _lines(t, t.seg, "SPEAKER ", F.col(REC), " 1 ", _seconds("segment_onset"), " ", F.format_string("%.3f", (F.col("segment_offset") - F.col("segment_onset")) / 1000), " <NA> <NA> ", F.col("speaker_type"), " <NA> <NA>")
    return formats.read(t.spark, "vtc_rttm", path).drop("raw_filename")


@query("SELECT segment_onset, segment_offset, (['CHI','CHI','CHI','OCH'])[row_no % 4 + 1] AS speaker_type, (['Y','N','C','NA'])[row_no % 4 + 1] AS vcm_type FROM seg WHERE recording_filename = 'rec1'")
def reader_vcm_rttm(t: Tables) -> DataFrame:
    """Of a file with all recordings, one."""
    name = F.element_at(F.array(*map(F.lit, ("CRY", "NCS", "CNS", "CHI"))), (F.col("row_no") % 4 + 1).cast("int"))
    path = _lines(t, t.seg, "SPEAKER ", F.col(REC), " 1 ", _seconds("segment_onset"), " ", F.format_string("%.3f", (F.col("segment_offset") - F.col("segment_onset")) / 1000), " <NA> <NA> ", name, " 1.0 <NA>")
    return formats.read(t.spark, "vcm_rttm", path, source_file="rec1").drop("raw_filename")


@query("SELECT segment_onset, segment_offset, phonemes, syllables, words FROM seg")
def reader_alice(t: Tables) -> DataFrame:
    path = _lines(t, t.seg, F.col(REC), "_", F.format_string("%012d", F.col("segment_onset") * 10), "_", F.format_string("%012d", F.col("segment_offset") * 10), ".wav ", F.col("phonemes"), " ", F.col("syllables"), " ", F.col("words"))
    return formats.read(t.spark, "alice", path).drop("raw_filename")


@query("SELECT segment_onset, segment_offset, 'CHI' AS speaker_type, (['C','N','J','Y','L'])[row_no % 5 + 1] AS vcm_type FROM seg")
def reader_w2v2(t: Tables) -> DataFrame:
    path = _folder(t)
    t.seg.select(F.concat_ws("_", REC, *SEGMENT).alias("id"), (F.col("row_no") % 5).alias("class")).write.csv(path, header=True)
    return formats.read(t.spark, "w2v2-sm", path).drop("raw_filename")


@query("SELECT segment_onset, segment_offset, CASE speaker_type WHEN 'NA' THEN 'NA' ELSE speaker_type END AS speaker_type, words, utterances_count, lena_conv_turn_type FROM seg")
def reader_its(t: Tables) -> DataFrame:
    code = formats.mapped(F.col("speaker_type"), {"CHI": "CHN", "FEM": "FAN", "MAL": "MAN", "OCH": "CXN"}, "OLN")
    line = F.concat(F.lit('<Segment spkr="'), code, F.lit('" startTime="PT'), _seconds("segment_onset"), F.lit('S" endTime="PT'), _seconds("segment_offset"), F.lit('S" femaleAdultWordCnt="'), F.col("words").cast("string"), F.lit('" childUttCnt="'), F.col("utterances_count").cast("string"), F.lit('" conversationInfo="|BC|0|0|CIC|NT|'), F.col("lena_conv_turn_type"), F.lit('|FI|"/>'))
    path = _documents(t, "its", '<ITS><Recording num="1"><Conversation num="1" type="CIC">\n', line, "\n</Conversation></Recording></ITS>")
    return formats.read(t.spark, "its", path).select(*SEGMENT, "speaker_type", "words", "utterances_count", "lena_conv_turn_type")


@query("SELECT segment_onset, segment_offset, 'CHI' AS speaker_type, (row_no % 2)::VARCHAR AS ling_type FROM seg")
def reader_textgrid(t: Tables) -> DataFrame:
    line = F.concat(F.lit("intervals [1]:\nxmin = "), _seconds("segment_onset"), F.lit("\nxmax = "), _seconds("segment_offset"), F.lit('\ntext = "'), (F.col("row_no") % 2).cast("string"), F.lit('"'))
    path = _documents(t, "TextGrid", 'File type = "ooTextFile"\nitem []:\nitem [1]:\nclass = "IntervalTier"\nname = "CHI"\n', line, "\n")
    return formats.read(t.spark, "TextGrid", path).select(*SEGMENT, "speaker_type", "ling_type")


@query("SELECT segment_onset, segment_offset, 'FEM' AS speaker_type, 'w' || row_no AS transcription, CASE WHEN row_no % 2 = 0 THEN 'T' ELSE 'NA' END AS addressee FROM seg")
def reader_eaf(t: Tables) -> DataFrame:
    n = F.col("row_no").cast("string")
    slot = lambda i, c: F.concat(F.lit(f'<TIME_SLOT TIME_SLOT_ID="t{i}_'), n, F.lit('" TIME_VALUE="'), F.col(c).cast("string"), F.lit('"/>'))
    mine = F.concat(F.lit('<TIER TIER_ID="FA1"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a'), n, F.lit('" TIME_SLOT_REF1="t1_'), n, F.lit('" TIME_SLOT_REF2="t2_'), n, F.lit('"><ANNOTATION_VALUE>w'), n, F.lit("</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER>"))
    whom = F.concat(F.lit('<TIER TIER_ID="xds@FA1"><ANNOTATION><REF_ANNOTATION ANNOTATION_ID="r'), n, F.lit('" ANNOTATION_REF="a'), n, F.lit('"><ANNOTATION_VALUE>T</ANNOTATION_VALUE></REF_ANNOTATION></ANNOTATION></TIER>'))
    line = F.concat(slot(1, "segment_onset"), slot(2, "segment_offset"), mine, F.when(F.col("row_no") % 2 == 0, whom).otherwise(""))
    path = _documents(t, "eaf", "<ANNOTATION_DOCUMENT>", line, "</ANNOTATION_DOCUMENT>")
    return formats.read(t.spark, "eaf", path).select(*SEGMENT, "speaker_type", "transcription", "addressee")


@query("SELECT segment_onset, segment_offset, CASE WHEN row_no % 2 = 0 THEN 'FEM' ELSE 'CHI' END AS speaker_type, 3.0 AS words FROM seg")
def reader_cha(t: Tables) -> DataFrame:
    line = F.concat(F.when(F.col("row_no") % 2 == 0, "*MOT").otherwise("*CHI"), F.lit(":\tone two (three) &um . \x15"), F.col("segment_onset").cast("string"), F.lit("_"), F.col("segment_offset").cast("string"), F.lit("\x15"))
    path = _documents(t, "cha", "@Begin\n@Participants:\tCHI Target_Child, MOT Mother\n", line, "\n@End")
    return formats.read(t.spark, "cha", path).select(*SEGMENT, "speaker_type", "words")


@query(f"SELECT * FROM (VALUES {', '.join(str(x) for x in sorted(formats.EXTENSIONS.items()))}) v(format, extension)")
def extension_map(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(sorted(formats.EXTENSIONS.items()), "format string, extension string")


@query("SELECT recording_filename || '.its' AS raw_filename, 0 AS range_onset, duration AS range_offset, recording_filename || '_0_' || duration || '.csv' AS annotation_filename FROM rec")
def full_range_imports(t: Tables) -> DataFrame:
    rows = manage.full_ranges(t.rec, "its", "its", formats.EXTENSIONS["its"])
    return rows.select("raw_filename", *RANGE, manage.annotation_filename().alias("annotation_filename"))


# audio: the values of a recording's events are its samples, ten a second, in two channels

_SIGNAL = "sig AS (SELECT 'rec' || user_id AS recording_filename, c AS channel, row_number() OVER (PARTITION BY user_id, c ORDER BY event_id) - 1 AS i, (CASE c WHEN 0 THEN value % 100 / 128.0 ELSE event_id % 64 / 128.0 END)::FLOAT AS x FROM events, (VALUES (0), (1)) v(c))"


def _signal(t: Tables) -> DataFrame:
    e = t.read("events").select(F.concat(F.lit("rec"), F.col("user_id").cast("string")).alias(REC), "event_id", F.explode(F.array(F.struct(F.lit(0).alias("channel"), (F.col("value") % 100 / 128).cast("float").alias("x")), F.struct(F.lit(1).alias("channel"), (F.col("event_id") % 64 / 128).cast("float").alias("x")))).alias("s")).select(REC, "event_id", "s.*")
    rows = e.groupBy(REC, "channel").agg(F.array_sort(F.collect_list(F.struct("event_id", "x"))).alias("all"))
    return rows.select(REC, "channel", F.lit(10).alias("rate"), F.lit(0).cast("bigint").alias("start_sample"), F.transform("all", lambda r: r["x"]).alias("samples"))


def _samples(signal: DataFrame) -> DataFrame:
    return signal.select(REC, "channel", "start_sample", F.posexplode("samples").alias("at", "x")).select(REC, F.col("channel").cast("bigint").alias("channel"), (F.col("start_sample") + F.col("at")).alias("i"), F.col("x").cast("double").alias("x"))


@query(f"{_SIGNAL} SELECT recording_filename, channel, i, round(CASE WHEN i BETWEEN 2 AND 4 OR i BETWEEN 9 AND 11 THEN 0 ELSE x::DOUBLE END, 6) AS x FROM sig")
def audio_vetting(t: Tables) -> DataFrame:
    span = lambda a, b: F.struct(F.lit(a).cast("bigint").alias("range_onset"), F.lit(b).cast("bigint").alias("range_offset"))
    ranges = t.rec.select(REC, F.explode(F.array(span(200, 500), span(900, 1200))).alias("r")).select(REC, "r.*")
    return _samples(audio.vet(_signal(t), ranges))


@query(f"{_SIGNAL} SELECT a.recording_filename, n AS channel, a.i, round(((CASE n WHEN 0 THEN 0.5 ELSE 1.0 END) * a.x::DOUBLE + (CASE n WHEN 0 THEN 0.25 ELSE 0.0 END) * b.x::DOUBLE)::FLOAT::DOUBLE, 6) AS x FROM sig a JOIN sig b ON a.recording_filename = b.recording_filename AND a.i = b.i AND a.channel = 0 AND b.channel = 1, (VALUES (0), (1)) m(n)")
def audio_channels(t: Tables) -> DataFrame:
    return _samples(audio.map_channels(_signal(t), [[0.5, 0.25], [1.0, 0.0]]))


@query(f"{_SIGNAL}, w AS (SELECT recording_filename, k, k * 300 AS segment_onset, k * 300 + 500 AS segment_offset FROM (SELECT recording_filename, max(i) + 1 AS n FROM sig GROUP BY 1), (SELECT unnest(range(0, 100000)) AS k) WHERE k * 3 + 5 <= n) SELECT recording_filename, segment_onset, segment_offset, round(sum(x::DOUBLE * x) / 5, 6) AS energy FROM w JOIN sig USING (recording_filename) WHERE i >= k * 3 AND i < k * 3 + 5 GROUP BY ALL")
def audio_energy(t: Tables) -> DataFrame:
    return sampling.window_energy(_signal(t), 10, 500, 300)


@query(f"{_SIGNAL} SELECT round(avg(abs(a.x::DOUBLE - b.x::DOUBLE)) * 1000, 6) AS difference, count(*) AS samples FROM sig a JOIN sig b USING (channel, i) WHERE a.recording_filename = 'rec1' AND b.recording_filename = 'rec1v' OR a.recording_filename = 'rec1' AND b.recording_filename = 'rec1'")
def audio_compare(t: Tables) -> DataFrame:
    """A recording and its copy."""
    s = _signal(t).where(F.col(REC) == "rec1")
    return audio.compare(s.unionByName(s.withColumn(REC, F.lit("copy"))), "rec1", "copy")


@query(f"{_SIGNAL} SELECT recording_filename || '_300_800.wav' AS recording_filename, channel, i - 3 AS i, round(x::DOUBLE, 6) AS x FROM sig WHERE i BETWEEN 3 AND 7")
def audio_clips(t: Tables) -> DataFrame:
    ranges = t.rec.select(REC, F.lit(300).cast("bigint").alias("segment_onset"), F.lit(800).cast("bigint").alias("segment_offset"))
    return _samples(audio.clips(_signal(t), ranges))


def _files(t: Tables) -> str:
    folder = _folder(t).removeprefix("file:")
    write_wav(_signal(t).withColumn(REC, _spread(F.concat(REC, F.lit(".wav")))), folder).count()
    return f"{folder}/*"


@query(f"{_SIGNAL} SELECT recording_filename || '.wav' AS recording_filename, channel, i, round(round_even(x::DOUBLE * 32767, 0) / 32768, 5) AS x FROM sig")
def audio_files(t: Tables) -> DataFrame:
    """Written as WAV and read again in blocks of a second."""
    return _samples(read_wav(t.spark, _files(t), 1000)).withColumn("x", F.round("x", 5))


@query(f"{_SIGNAL} SELECT recording_filename || '.wav' AS recording_filename, (max(i) + 1) * 100 AS duration FROM sig GROUP BY 1")
def audio_durations(t: Tables) -> DataFrame:
    return durations(t.spark, _files(t))


# bookkeeping and validation

_WINDOWS = [(0, 6), (5, 9), (8, 20), (22, 3), (23, 23), (12, 0), (3, 22)]


@query(f"""w AS (SELECT * FROM (VALUES {", ".join(map(str, _WINDOWS))}) v(a, b)), h AS (SELECT unnest(range(0, 24)) AS h),
i AS (SELECT a, b, h FROM w, h WHERE a = b OR (a < b AND h >= a AND h < b) OR (a > b AND (h >= a OR h < b)))
SELECT x.a AS a, x.b AS b, y.a AS c, y.b AS d, count(*) AS hours FROM i x JOIN i y USING (h) GROUP BY ALL""")
def circular_windows(t: Tables) -> DataFrame:
    rows = []
    for a, b in _WINDOWS:
        for c, d in _WINDOWS:
            shared = circular_intersect((a * HOUR, b * HOUR), (c * HOUR, d * HOUR))
            if hours := sum(((stop - start) // HOUR - 1) % 24 + 1 for start, stop in shared):
                rows.append((a, b, c, d, hours))
    return t.spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint, hours bigint")


@query("SELECT row_no, '<Child id=\"X\" DOB=\"1000-01-01T0' || row_no % 10 || '\"/>' AS value FROM seg")
def anonymised_lines(t: Tables) -> DataFrame:
    value = F.concat(F.lit('<Child id="'), F.col(REC), F.lit('" DOB="2020-02-03T0'), (F.col("row_no") % 10).cast("string"), F.lit('"/>'))
    return manage.anonymise(t.seg.select("row_no", value.alias("value")), {("Child", "id"): "X", ("Child", "DOB"): "1000-01-01"})


@query("SELECT * FROM (VALUES ('begins'), ('segment_count')) v(\"column\")")
def unknown_columns(t: Tables) -> DataFrame:
    extra = t.rec.withColumns({"begins": F.lit(1), "segment_count": F.lit(2)}).select(REC, "begins", "segment_count")
    return t.spark.createDataFrame([(c,) for c in validate.unknown_columns(extra, (*RECORDINGS, Rule("unused")))], "column string")


@query("SELECT DISTINCT 'e' || child_id % 3 AS experiment FROM chi WHERE (SELECT count(DISTINCT child_id % 3) FROM chi) > 1")
def several_experiments(t: Tables) -> DataFrame:
    return validate.several_experiments(t.chi.withColumn("experiment", F.concat(F.lit("e"), (F.col("child_id") % 3).cast("string"))))


_IMPORTS = f"rows AS (SELECT recording_filename, range_onset, CASE WHEN range_onset % 7 = 0 THEN range_onset ELSE range_offset END AS range_offset, 0 AS extra FROM idx WHERE set = 'a' UNION ALL SELECT recording_filename, range_onset + {HOUR}, range_offset + {HOUR}, 1 FROM idx WHERE set = 'a' AND range_onset // 86400000 % 5 = 1), known AS (SELECT recording_filename, duration FROM rec WHERE discard != '1'), o AS (SELECT *, range_offset > range_onset AND (coalesce(max(range_offset) OVER (PARTITION BY recording_filename, range_offset > range_onset ORDER BY range_onset, range_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > range_onset, false) OR coalesce(lead(range_onset) OVER (PARTITION BY recording_filename, range_offset > range_onset ORDER BY range_onset, range_offset) < range_offset, false)) AS meets FROM rows)"


@query(f"{_IMPORTS} SELECT recording_filename, range_onset, range_offset, CASE WHEN range_offset <= range_onset OR range_onset < 0 THEN 'range is not valid' WHEN duration IS NULL THEN 'recording is unknown' WHEN range_offset > duration THEN 'range exceeds the recording' WHEN meets THEN 'ranges overlap' END AS error FROM o LEFT JOIN known USING (recording_filename)")
def import_checks(t: Tables) -> DataFrame:
    a = t.idx.where("set = 'a'").select("set", REC, *RANGE)
    rows = a.withColumn("range_offset", F.when(F.col("range_onset") % 7 == 0, F.col("range_onset")).otherwise(F.col("range_offset")))
    late = a.where("range_onset div 86400000 % 5 = 1").withColumns({c: F.col(c) + HOUR for c in RANGE})
    return validate.check_import(rows.unionByName(late), t.rec.where("discard != '1'")).select(REC, *RANGE, "error")


@query("SELECT event_id AS index, CASE WHEN event_id % 6 = 0 THEN 's' WHEN event_id % 3 = 0 THEN NULL END AS subject_set, event_id % 3 = 0 OR event_id % 10 = 1 AS uploaded, event_id % 3 = 0 AND event_id % 6 != 0 AS orphan FROM events")
def chunk_states(t: Tables) -> DataFrame:
    """Some chunks are uploaded; a later upload is written back; uploaded ones without a subject set are orphans."""
    n = F.col("event_id")
    chunks = t.read("events").select(n.alias("index"), (n % 3 == 0).alias("uploaded"), F.when(n % 3 == 0, 1).alias("project_id"), F.when(n % 3 == 0, n).alias("zooniverse_id"), F.when(n % 6 == 0, "s").alias("subject_set"))
    done = manage.update_chunks(chunks, chunks.where("index % 10 = 1 and not uploaded").select("index", F.lit(True).alias("uploaded")))
    lost = manage.orphan_chunks(done).select("index", F.lit(True).alias("orphan"))
    return done.join(lost, "index", "left").select("index", "subject_set", "uploaded", F.coalesce("orphan", F.lit(False)).alias("orphan"))


@query("SELECT event_id AS index FROM events WHERE event_id % 3 != 0 ORDER BY event_id LIMIT 100")
def next_uploads(t: Tables) -> DataFrame:
    return manage.next_upload(t.read("events").select(F.col("event_id").alias("index"), (F.col("event_id") % 3 == 0).alias("uploaded")), 100).select("index")


@query("SELECT 'child' AS set, row_no, recording_filename, greatest(segment_onset, range_onset) AS segment_onset, least(segment_offset, range_offset) AS segment_offset FROM ann JOIN idx USING (set, recording_filename) WHERE set = 'b' AND speaker_type = 'CHI' AND segment_onset < range_offset AND range_onset < segment_offset")
def derived_set(t: Tables) -> DataFrame:
    """A derivation of one's own: the key child's segments of a set, cut to its ranges."""
    ranged = t.ann.where("set = 'b'").join(t.idx.select("set", REC, *RANGE), ["set", REC])
    out, _ = derive.derive(ranged, t.idx, "b", "child", lambda s: s.where("speaker_type = 'CHI'"))
    return out.select("set", "row_no", REC, *SEGMENT)


@query(f"{_GRID}, runs AS (SELECT *, frame - row_number() OVER (PARTITION BY recording_filename, coder, category ORDER BY frame) AS run FROM fr) SELECT recording_filename, coder, category, min(frame) * {_FRAME} AS segment_onset, (max(frame) + 1) * {_FRAME} AS segment_offset FROM runs GROUP BY recording_filename, coder, category, run")
def segments_of_frames(t: Tables) -> DataFrame:
    return reliability.segments_of(_grid(t).where("category != 'none'"), _FRAME)


@query("SELECT recording_filename, printf('%.1f h', duration / 3600000.0) AS hours, duration || ' ms' AS ms FROM rec")
def printable_durations(t: Tables) -> DataFrame:
    return t.rec.select(REC, manage.printable("duration", "h").alias("hours"), manage.printable("duration", "ms").alias("ms"))


@query("SELECT CASE WHEN recording_filename = 'rec1' THEN 'first' ELSE recording_filename END AS recording_filename, count(*) AS n FROM seg GROUP BY 1")
def renamed_recording(t: Tables) -> DataFrame:
    return manage.rename_recording([t.seg], "rec1", "first")[0].groupBy(REC).agg(F.count("*").alias("n"))
