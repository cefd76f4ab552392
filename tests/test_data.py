"""Validation, bookkeeping, formats, tables and streams."""

from __future__ import annotations

import pytest
from conftest import values
from pyspark.sql import functions as F

from earshot import schema
from earshot.operators import validate
from earshot.plans import manage
from earshot.sources import formats, tables
from earshot.streaming import segments as streaming

REC = "recording_filename string, child_id string, date_iso string, duration bigint"
IDX = "set string, recording_filename string, range_onset bigint, range_offset bigint, imported_at string, merged_from string"


def test_rules(frame):
    df = frame("_line bigint, child_id string, child_sex string, child_dob string, order_of_birth string", (2, "1", "m", "2020-01-01", "1"), (3, None, "x", "yesterday", "1.0"), (4, "1", "NA", "NA", "one"))
    got = values(validate.violations(df, schema.CHILDREN), "column", "line", "problem", "severity")
    assert got == [("child_dob", 3, "invalid", "error"), ("child_id", 3, "null", "error"), ("child_sex", 3, "invalid", "warning"), ("experiment", None, "missing column", "error"), ("order_of_birth", 4, "invalid", "warning")]
    assert values(validate.duplicates(df, ["child_id"])) == [("1", 2, "2,4")]
    assert validate.unknown_columns(df.withColumn("zz", F.lit(1)), schema.CHILDREN) == ["zz"]


def test_patterns_match_whole_values(frame):
    df = frame("_line bigint, a string", (2, "12"), (3, "12\n"), (4, "x12"))
    assert values(validate.violations(df, (schema.Rule("a", True, regex="[0-9]+"),)), "line") == [(3,), (4,)]


def test_index_checks(frame):
    idx = frame(IDX, ("a", "x", 0, 10, "2", None), ("a", "x", 9, 12, "1", None), ("a", "y", 5, 5, "1", None), ("b", "x", 0, 99, "3", None), ("m", "x", 0, 9, "2", "a,b,gone"))
    rec = frame(REC, ("x", "1", "2020-01-01", 50), ("y", "9", "2019-01-01", 50))
    assert values(validate.overlapping_ranges(idx), "range_onset") == [(0,), (9,)]
    assert values(validate.range_errors(idx), "recording_filename") == [("y",)]
    assert values(validate.duration_overflow(idx, rec), "set", "recording_duration") == [("b", 50)]
    assert values(validate.outdated_merges(idx)) == [("m", "b", "imported later"), ("m", "gone", "gone")]
    chi = frame("child_id string, child_dob string, experiment string", ("1", "2020-01-01", "e"), ("9", "2019-02-01", "f"))
    assert values(validate.orphans(rec, chi.where("child_id = '1'"), ["child_id"]), "recording_filename") == [("y",)]
    assert values(validate.negative_ages(rec, chi), "recording_filename") == [("y",)] and validate.several_experiments(chi).count() == 2


def test_imports(frame):
    rec = frame(REC, ("x", "1", "2020-01-01", 100))
    have = frame(IDX, ("a", "x", 0, 10, "1", None))
    new = frame(IDX, ("a", "x", 0, 10, "2", None), ("a", "x", 5, 20, "2", None), ("b", "x", 0, 10, "2", None), ("b", "q", 0, 10, "2", None), ("b", "x", 90, 101, "2", None), ("b", "x", 30, 20, "2", None))
    kept, bad = manage.import_rows(have, new, rec)
    assert values(kept, "set", "imported_at") == [("a", "1"), ("b", "2")]
    assert {r[0] for r in values(bad, "error")} == {"ranges overlap", "recording is unknown", "range exceeds the recording", "range is not valid"}
    kept, _ = manage.import_rows(have, new.limit(1), rec, overwrite=True)
    assert values(kept, "set", "imported_at") == [("a", "2")]
    assert values(manage.full_ranges(rec, "v", "vtc_rttm", "rttm"), "raw_filename", "range_offset") == [("x.rttm", 100)]


def test_overlays_discards_and_ages(frame):
    chi = frame("child_id string, child_dob string, discard string", ("1", "2020-01-01", "random text"), ("2", "2019-01-01", "1"), ("3", "x", "1.0"))
    new = manage.overlay(chi, [frame("child_id string, child_dob string, note string", ("1", "2018-01-01", "n"), ("2", None, None))], "child_id")
    assert values(new, "child_id", "child_dob", "note") == [("1", "2018-01-01", "n"), ("2", "2019-01-01", None), ("3", "x", None)]
    kept, gone = manage.split_discarded(new)
    assert values(kept, "child_id") == [("1",)] and values(gone, "child_id") == [("2",), ("3",)]
    rec = frame(REC, ("x", "1", "2020-03-01", 1), ("y", "3", "2020-01-01", 1), ("z", "1", "2020-01-01", 1))
    got = values(manage.ages(rec, chi), "recording_filename", "age_days", F.round("age", 4))
    assert got == [("x", 60, 1.9713), ("y", None, None), ("z", 0, 0.0)]
    assert values(manage.ages(rec, chi, zero_is_null=True), "recording_filename", "age_days")[2] == ("z", None)
    with pytest.raises(ValueError, match="nowhere"):
        manage.recordings_from_list(rec, ["x", "nowhere", "NA"])


def test_sets_are_renamed_merged_and_removed(frame):
    idx = frame(IDX, ("a", "x", 0, 10, "1", None), ("b", "x", 5, 20, "1", None), ("m", "x", 5, 10, "2", "a,b"))
    assert values(manage.rename_set(idx, "a", "z"), "set", "merged_from") == [("b", None), ("m", "z,b"), ("z", None)]
    for pair in (("a", "b"), ("q", "r")):
        with pytest.raises(ValueError):
            manage.rename_set(idx, *pair)
    assert values(manage.remove_set(idx, "a"), "set") == [("b",), ("m",)]
    assert values(manage.rename_recording([idx.limit(1)], "x", "w")[0], "recording_filename") == [("w",)]
    seg = frame("set string, recording_filename string, segment_onset bigint, segment_offset bigint, speaker_type string, words double, raw_filename string", ("a", "x", 2, 7, "CHI", None, "l"), ("b", "x", 5, 7, None, 3.0, "r"), ("b", "x", 15, 17, None, 4.0, "r"))
    merged, index = manage.merge(seg, idx, "a", "b", ["speaker_type"], ["words"], "ab")
    assert values(merged, "segment_onset", "segment_offset", "speaker_type", "words", "raw_filename", "set") == [(5, 7, "CHI", "3.0", "l,r", "ab")]
    assert values(index, "range_onset", "range_offset", "merged_from") == [(5, 10, "a,b")]


def test_segments_get_their_index(frame):
    seg = frame("set string, annotation_filename string, segment_onset bigint, segment_offset bigint, raw_filename string, time_seek int", ("a", "f", 0, 10, "own", 7), ("a", "f", 30, 40, "own", 7))
    idx = frame("set string, annotation_filename string, recording_filename string, range_onset bigint, range_offset bigint, raw_filename string, time_seek int", ("a", "f", "x", 5, 20, "theirs", 0))
    assert values(manage.attach(seg, idx), "recording_filename", "segment_onset", "segment_offset", "raw_filename", "time_seek") == [("x", 5, 10, "own", 0)]


def test_small_reports(frame):
    rec = frame(REC + ", recording_device_type string", ("x", "1", "2020-03-01", 5, "usb"), ("y", "1", "2020-04-01", 7, "usb"))
    chi = frame("child_id string, child_dob string, child_sex string, languages string", ("1", "2020-01-01", "m", "eng; fra;"), ("2", "2020-01-01", "F", "fra"))
    assert values(manage.languages(chi)) == [("eng", 1), ("fra", 2)] and values(manage.devices(rec)) == [("usb", 2, 12)]
    r = manage.overview(rec, chi).first()
    assert (r["recordings"], r["children"], r["boys"], r["girls"], r["monolingual"], r["least_age_days"]) == (2, 2, 1, 1, None, 60)
    assert [r[0] for r in rec.select(manage.printable("duration", "s")).collect()] == ["0.0 s", "0.0 s"]
    lines = frame("value string", '<Child id="secret" DOB="2020-05-06T10:00"/>', '<Other id="kept"/>')
    got = [r[0] for r in manage.anonymise(lines, {("Child", "id"): "A1", ("Child", "DOB"): "1000-01-01"}).collect()]
    assert got == ['<Child id="A1" DOB="1000-01-01T10:00"/>', '<Other id="kept"/>']


def test_chunk_states(frame):
    S = "index bigint, uploaded boolean, project_id bigint, zooniverse_id bigint, subject_set string"
    df = frame(S, (0, True, 1, 2, "s"), (1, False, None, None, None), (2, True, 1, 3, None), (3, None, None, None, None))
    assert values(manage.next_upload(df, 1), "index") == [(1,)] and values(manage.orphan_chunks(df), "index") == [(2,)]
    done = manage.update_chunks(df, frame("index bigint, uploaded boolean, zooniverse_id bigint", (1, True, 9)))
    assert values(done.where("zooniverse_id = 9"), "index", "uploaded") == [(1, True)]


def test_line_formats(spark, tmp_path):
    (tmp_path / "v.rttm").write_text("SPEAKER f1 1 1984.136 0.857 <NA> <NA> KCHI <NA> <NA>\nSPEAKER f1 1 1985.4920000000002 3.4589999999999996 <NA> <NA> CHI <NA> <NA>\nSPEAKER f2 1 0.0 1.0 <NA> <NA> SPEECH <NA> <NA>\n")
    assert values(formats.read(spark, "vtc_rttm", str(tmp_path / "v.rttm"))) == [("v.rttm", 0, 1000, "NA"), ("v.rttm", 1984136, 1984993, "CHI"), ("v.rttm", 1985492, 1988951, "OCH")]
    assert formats.read(spark, "vtc_rttm", str(tmp_path / "v.rttm"), source_file="f2").count() == 1
    (tmp_path / "m.rttm").write_text("SPEAKER f 1 13.993 1.065 <NA> <NA> MAL <NA> <NA>\nSPEAKER f 1 16.991 3.520 <NA> <NA> CRY 1.00 <NA>\nSPEAKER f 1 20 1 <NA> <NA> CNS 1.00 <NA>\n")
    assert values(formats.read(spark, "vcm_rttm", str(tmp_path / "m.rttm")), "segment_onset", "speaker_type", "vcm_type") == [(13993, "MAL", "NA"), (16991, "CHI", "Y"), (20000, "CHI", "C")]
    (tmp_path / "a.txt").write_text("FileName\tphonemes\tsyllables\twords\nclip_x_0000012345_0000067890.wav\t9 4 2\n")
    assert values(formats.read(spark, "alice", str(tmp_path / "a.txt")), "segment_onset", "segment_offset", "phonemes", "words") == [(1234, 6789, 9.0, 2.0)]
    (tmp_path / "w.csv").write_text("id,class\nrec_1_500_900,3\nbad,1\n")
    assert values(formats.read(spark, "w2v2-sm", str(tmp_path / "w.csv")), "segment_onset", "segment_offset", "vcm_type") == [(500, 900, "Y")]
    (tmp_path / "c.csv").write_text("segment_onset,segment_offset,speaker_type\n1,2,NA\n3,4.0,CHI\n")
    assert values(formats.read(spark, "csv", str(tmp_path / "c.csv")), "segment_onset", "segment_offset", "speaker_type") == [(1, 2, None), (3, 4, "CHI")]
    with pytest.raises(ValueError):
        formats.read(spark, "mp3", "x")


ITS = """<?xml version="1.0"?><ITS><ProcessingUnit><Recording num="1">
<Pause num="1"><Segment spkr="OLN" average_dB="-30.5" peak_dB="-10" startTime="PT0S" endTime="PT1.5S"/></Pause>
<Conversation num="1" type="CIC"><Segment spkr="CHN" conversationInfo="|BC|1|1|0|CIC|TIFR|FH|" childUttCnt="2" childUttLen="P0.5S" startUtt1="PT1.5S" endUtt1="PT2S" startCry1="PT2.1S" endCry1="PT2.25S" childCryVfxLen="PT0.15S" average_dB="-20" peak_dB="-5" startTime="PT1.50S" endTime="PT2.26S"/></Conversation>
</Recording><Recording num="2"><Pause num="9"><Segment spkr="FAN" femaleAdultWordCnt="3.5" startTime="PT0S" endTime="PT1S"/></Pause></Recording></ProcessingUnit></ITS>"""


def test_lena(spark, tmp_path):
    (tmp_path / "l.its").write_text(ITS)
    df = formats.read(spark, "its", str(tmp_path / "l.its"))
    got = [r.asDict(True) for r in df.orderBy("segment_onset", "segment_offset").collect()]
    assert [(r["segment_onset"], r["segment_offset"], r["speaker_type"], r["words"], r["lena_block_type"]) for r in got] == [(0, 1000, "FEM", 3.5, "pause"), (0, 1500, "NA", 0.0, "pause"), (1500, 2260, "CHI", 0.0, "CIC")]
    child = got[2]
    assert (child["lena_conv_status"], child["lena_response_count"], child["lena_conv_turn_type"], child["lena_conv_floor_type"]) == ("BC", "0", "TIFR", "FH")
    assert (child["utterances_count"], child["utterances_length"], child["child_cry_vfx_len"], child["cries"], child["vfxs"]) == (2.0, 500.0, 150.0, [{"start": 2.1, "end": 2.25}], [])
    assert formats.read(spark, "its", str(tmp_path / "l.its"), recording_num=2).count() == 1


def test_documents(spark, tmp_path):
    (tmp_path / "t.TextGrid").write_text('item [1]:\n name = "FA1"\n intervals [1]:\n xmin = 0\n xmax = 1.25\n text = "1"\n intervals [2]:\n xmin = 1.25\n xmax = 2\n text = ""\nitem [2]:\n name = "Autre"\n intervals [1]:\n xmin = 0\n xmax = 2\n text = "x"\n')
    assert values(formats.read(spark, "TextGrid", str(tmp_path / "t.TextGrid"))) == [("t.TextGrid", 0, 1250, "FA1", "FEM", "1")]
    slots = '<TIME_ORDER><TIME_SLOT TIME_SLOT_ID="a" TIME_VALUE="100"/><TIME_SLOT TIME_SLOT_ID="b" TIME_VALUE="900"/></TIME_ORDER>'
    ref = lambda tier, i, of, v: f'<TIER TIER_ID="{tier}"><ANNOTATION><REF_ANNOTATION ANNOTATION_ID="{i}" ANNOTATION_REF="{of}"><ANNOTATION_VALUE>{v}</ANNOTATION_VALUE></REF_ANNOTATION></ANNOTATION></TIER>'
    (tmp_path / "e.eaf").write_text(f'<ANNOTATION_DOCUMENT>{slots}<TIER TIER_ID="CHI"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="1" TIME_SLOT_REF1="a" TIME_SLOT_REF2="b"><ANNOTATION_VALUE>ba ba.</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER>{ref("vcm@CHI", "2", "1", "C")}{ref("lex@CHI", "3", "2", "W")}{ref("note@CHI", "4", "1", "hm")}</ANNOTATION_DOCUMENT>')
    assert values(formats.read(spark, "eaf", str(tmp_path / "e.eaf"), new_tiers=["note"]), "segment_onset", "speaker_type", "transcription", "vcm_type", "lex_type", "mwu_type", "note") == [(100, "CHI", "ba ba.", "C", "W", "NA", "hm")]
    (tmp_path / "c.cha").write_text("@UTF8\n@Participants:\tCHI Target_Child , MOT Mary Mother\n*MOT:\thello you 2 there .\n\tagain . \x151000_2500\x15\n%add:\tCHI\n*CHI:\tno time .\n*CHI:\tba . \x153000_3100\x15\n@End\n")
    assert values(formats.read(spark, "cha", str(tmp_path / "c.cha")), "segment_onset", "segment_offset", "speaker_type", "words", "addressee") == [(1000, 2500, "FEM", 4.0, "T"), (3000, 3100, "CHI", 1.0, "NA")]


def test_documents_are_written_by_tasks(spark, frame, tmp_path):
    docs = frame("name string, value string", *[(f"{i % 3}/r {i}+ä.cha", f"@Participants:\tCHI Target_Child\n*CHI:\tbé . \x15{i}_{i + 5}\x15\n") for i in range(40)])
    folder = f"file:{tmp_path}/docs"
    written = values(formats.write_documents(docs, folder))
    assert [n for n, _ in written] == sorted(f"{i % 3}/r {i}+ä.cha" for i in range(40)) and all(size == (tmp_path / "docs" / n).stat().st_size for n, size in written)
    assert len(list((tmp_path / "docs").glob("*/*"))) == 40
    got = values(formats.read(spark, "cha", f"{folder}/*"), "raw_filename", "segment_onset", "segment_offset", "words")
    assert got == sorted((f"r {i}+ä.cha", i, i + 5, 1.0) for i in range(40))


def test_queries_spread_files_over_few_folders(spark, tmp_path):
    from pathlib import Path

    from earshot.plans import io_queries
    from earshot.plans.queries import Tables

    spark.sql("SELECT event_id, timestamp_ntz'2024-01-02' + make_dt_interval(0, 0, 0, event_id) AS ts, event_id % 600 AS user_id, 'click' AS event_type, 2.5D AS value FROM range(1200) t(event_id)").write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    for path, end in ((io_queries._documents(t, "cha", "", F.lit("x"), ""), "cha"), (io_queries._files(t), "wav")):
        found = list(Path(path.removeprefix("file:").removesuffix("/*")).glob("*/*"))
        assert {f.name for f in found} == {f"rec{i}.{end}" for i in range(600)} and 1 < len({f.parent for f in found}) <= io_queries.FOLDERS


def test_tables_and_sinks(spark, frame, tmp_path):
    meta = tmp_path / "metadata"
    (meta / "recordings").mkdir(parents=True)
    (meta / "children.csv").write_text("experiment,child_id,child_dob\ntest,1,2020-01-01\ntest,NA,\n")
    (meta / "recordings.csv").write_text("experiment,child_id,date_iso,start_time,recording_device_type,recording_filename,duration,discard\ntest,1,2020-04-20,9:00,usb,a.wav,4000,\ntest,1,2020-04-21,9:00,usb,b.wav,4000,1\n")
    (meta / "recordings" / "0_x.csv").write_text("recording_filename,date_iso\na.wav,2021-01-01\n")
    (meta / "recordings" / "1_y.csv").write_text("recording_filename,date_iso,noisy_setting\na.wav,2022-01-01,yes\n")
    data = tables.read_dataset(spark, str(tmp_path))
    assert values(data["children"], "child_id", "child_dob") == [("1", "2020-01-01"), ("NA", None)]
    assert values(data["recordings"], "recording_filename", "date_iso", "noisy_setting", "duration") == [("a.wav", "2021-01-01", "yes", 4000)]
    assert values(data["discarded_recordings"], "recording_filename") == [("b.wav",)]
    lines = tables.read_table(spark, str(meta / "children.csv"), schema.CHILDREN, line=True)
    assert values(validate.violations(lines, schema.CHILDREN), "column", "line", "problem") == [("child_dob", 3, "null")]
    seg = frame("set string, recording_filename string, segment_onset bigint, segment_offset bigint", ("a", "x", 5, 6), ("a", "x", 1, 2), ("b/c", "y", 0, 1))
    tables.write_segments(seg, str(tmp_path / "seg"))
    back = spark.read.parquet(str(tmp_path / "seg"))
    assert values(back.where("set = 'a'"), "segment_onset") == [(1,), (5,)] and "PartitionFilters: [isnotnull(set" in back.where("set = 'a'")._jdf.queryExecution().toString()
    idx = frame(IDX, ("a", "x.wav", 0, 10, "1", None), ("a", "x.wav", 0, 10, "2", None))
    tables.write_index(idx, str(tmp_path / "idx"))
    assert values(spark.read.parquet(str(tmp_path / "idx")), "annotation_filename", "imported_at") == [("x_0_10.csv", "2")]
    tables.write_recordings(data["recordings"], data["discarded_recordings"], str(tmp_path / "rec"))
    assert values(spark.read.csv(str(tmp_path / "rec"), header=True).where("discard = '1'"), "recording_filename") == [("b.wav",)]
    assert schema.content_of(["speaker_type", "words"]) == {"has_speaker_type": "Y", "has_words": "Y"}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("x", "CHI", 0, 500, "2020-01-01 09:10:00"), ("x", "CHI", 0, 700, "2020-01-01 09:10:03"), ("x", "FEM", 0, 100, "2020-01-01 10:00:00"), ("x", "NA", 0, 1, "2020-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "recording_filename string, speaker_type string, segment_onset bigint, segment_offset bigint, t string").withColumn("onset_time", F.to_timestamp("t")).drop("t")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    for name, plan, want in (("h", streaming.hourly(stream), {("CHI", 2, 1200), ("FEM", 1, 100)}), ("s", streaming.sessions(stream), {(2, 700), (1, 100)})):
        q = plan.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        cols = ["speaker_type", "voc", "voc_dur"] if name == "h" else ["voc_count", "segment_offset"]
        assert want <= {tuple(r) for r in spark.table(name).select(*cols).collect()}
