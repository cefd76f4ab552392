from __future__ import annotations

import pytest
from conftest import values

from earshot import __main__ as cli
from earshot.plans.dataset import Dataset, load_yaml


@pytest.fixture
def data(spark, tmp_path):
    root = tmp_path / "set"
    ds = Dataset.create(spark, str(root))
    (root / "metadata" / "children.csv").write_text("experiment,child_id,child_dob\ntest,1,2020-01-01\n")
    (root / "metadata" / "recordings.csv").write_text("experiment,child_id,date_iso,start_time,recording_device_type,recording_filename,duration\ntest,1,2020-04-20,9:00,usb,a.wav,4000\ntest,1,2020-04-21,9:00,usb,b.wav,4000\n")
    raw = root / "annotations" / "vtc" / "raw"
    raw.mkdir(parents=True)
    lines = lambda rows: "".join(f"SPEAKER x 1 {a / 1000} {(b - a) / 1000} <NA> <NA> {k} <NA> <NA>\n" for a, b, k in rows)
    (raw / "a.rttm").write_text(lines([(0, 342, "KCHI"), (500, 900, "FEM"), (1000, 1300, "KCHI"), (3900, 4400, "MAL")]))
    (raw / "b.rttm").write_text(lines([(100, 200, "FEM")]))
    (root / "annotations" / "vtc" / "metannots.yml").write_text("method: automated\nannotation_algorithm_name: VTC\n")
    return ds


def run(data, *args):
    return cli.main([args[0], data.root, *map(str, args[1:])])


def test_life_of_a_dataset(spark, data, tmp_path, capsys):
    assert run(data, "automated-import", "vtc", "vtc_rttm") == 0
    assert values(data.segments(), "recording_filename", "segment_onset", "segment_offset", "speaker_type") == [("a.wav", 0, 342, "CHI"), ("a.wav", 500, 900, "FEM"), ("a.wav", 1000, 1300, "CHI"), ("a.wav", 3900, 4000, "MAL"), ("b.wav", 100, 200, "FEM")]
    assert run(data, "automated-import", "vtc", "vtc_rttm") == 1  # it is there already
    assert run(data, "automated-import", "vtc", "vtc_rttm", "--overwrite") == 0 and data.segments().count() == 5
    assert run(data, "validate") == 0
    assert run(data, "overview") == run(data, "sets-metadata") == run(data, "explain", "child_dob") == 0
    assert "automated" in capsys.readouterr().out
    run(data, "derive-annotations", "conversations", "vtc", "vtc/conv")
    assert values(data.segments().where("set = 'vtc/conv' and conv_count is not null"), "segment_onset", "is_CT") == [(0, False), (500, True), (1000, True), (3900, True)]
    run(data, "conversations", "vtc/conv", tmp_path / "conv")
    assert values(spark.read.csv(str(tmp_path / "conv"), header=True), "conversation_onset", "voc_count", "initiator") == [("0", "4", "CHI")]
    run(data, "metrics", tmp_path / "m", "--aclew", "vtc", "--by", "child_id")
    first = spark.read.csv(str(tmp_path / "m"), header=True)
    assert values(first, "child_id", "duration_vtc", "voc_chi_ph") == [("1", "8000", "900.0")]
    run(data, "metrics", tmp_path / "again", "--spec", tmp_path / "m.parameters.yml")
    assert values(spark.read.csv(str(tmp_path / "again"), header=True)) == values(first)
    for sampler, n in (("periodic", 4), ("random", 4), ("conversations", 3)):
        run(data, "sample", sampler, tmp_path / sampler, "--set", "vtc", "--length", 500, "--period", 1500, "--count", 3)
        assert spark.read.csv(str(tmp_path / sampler), header=True).count() == n
    run(data, "merge-annotations", "vtc", "vtc/conv", "both", "--left-columns", "speaker_type", "--right-columns", "conv_count")
    assert values(data.segments().where("set = 'both' and recording_filename = 'a.wav'"), "segment_onset", "speaker_type", "conv_count") == [(0, "CHI", 1), (500, "FEM", 1), (1000, "CHI", 1), (3900, "MAL", 1)]
    run(data, "intersect-annotations", "vtc,both", tmp_path / "both")
    assert spark.read.csv(str(tmp_path / "both"), header=True).count() == 4
    run(data, "rename-annotations", "vtc", "voices")
    run(data, "remove-annotations", "vtc/conv")
    assert values(data.index().select("set").distinct()) == [("both",), ("voices",)]
    assert values(data.index().where("set = 'both'").select("merged_from").distinct()) == [("voices,vtc/conv",)]
    assert ("index", "outdated merge") in values(data.validate(), "source", "problem")


def test_broken_metadata_is_found(data, tmp_path):
    (tmp_path / "set" / "metadata" / "children.csv").write_text("experiment,child_id,child_dob\ntest,2,01/02/2020\n")
    assert run(data, "validate") == 1
    got = values(data.validate(), "source", "column", "problem")
    assert ("children", "child_dob", "invalid") in got and ("recordings", "child_id", "unknown child") in got


def test_rejected_rows_are_kept(spark, data, frame, tmp_path):
    rows = frame("set string, recording_filename string, range_onset bigint, range_offset bigint, time_seek bigint, raw_filename string, format string", ("vtc", "a.wav", 0, 1000, 100, "a.rttm", "vtc_rttm"), ("vtc", "a.wav", 2000, 9000, 0, "a.rttm", "vtc_rttm"))
    bad = data.import_annotations(rows)
    assert values(bad, "range_onset", "error") == [(2000, "range exceeds the recording")]
    assert values(data.segments(), "segment_onset", "segment_offset") == [(100, 442), (600, 1000)]
    assert spark.read.csv(str(tmp_path / "set" / "extra" / "errors_*"), header=True).count() == 1


def test_specifications():
    assert load_yaml("a: 1\nb: x\n")["b"] == "x" and load_yaml('{"a": [1]}') == {"a": [1]}


def test_recordings_and_templates(spark, data, tmp_path, capsys):
    import numpy as np

    from earshot.sources.audio import encode
    from earshot.sources.formats import read

    root = tmp_path / "set"
    rng = np.random.default_rng(1)
    loud = np.concatenate([np.zeros(2000), rng.normal(0, 0.3, 2000)])[:, None]
    (root / "recordings" / "a.wav").write_bytes(encode(loud, 1000))
    (root / "recordings" / "b.wav").write_bytes(encode(loud * 0.5, 1000))
    (root / "recordings" / "c.wav").write_bytes(encode(loud, 1000))
    run(data, "automated-import", "vtc", "vtc_rttm")
    assert values(data.unindexed_files()) == [("c.wav", "not indexed")]
    run(data, "compute-durations", "--overwrite")
    assert values(data.tables()["recordings"], "recording_filename", "duration") == [("a.wav", 4000), ("b.wav", 4000)]
    run(data, "compare-recordings", "a.wav", "c.wav")
    assert "0.0" in capsys.readouterr().out
    run(data, "sample", "energy", tmp_path / "energy", "--length", 500, "--period", 500, "--count", 2, "--threshold", "0.5")
    found = spark.read.csv(str(tmp_path / "energy"), header=True)
    assert found.count() == 6 and all(int(r["segment_onset"]) >= 2000 for r in found.collect())
    (tmp_path / "spans.csv").write_text("recording_filename,segment_onset,segment_offset\na.wav,1000,2000\na.wav,3000,3500\n")
    run(data, "sample", "custom", tmp_path / "custom", "--table", tmp_path / "spans.csv", "--exclude", tmp_path / "spans.csv")
    assert spark.read.csv(str(tmp_path / "custom"), header=True).count() == 0
    run(data, "eaf-builder", tmp_path / "spans.csv", tmp_path / "eaf", "--context", 100)
    text = (tmp_path / "eaf" / "a.eaf").read_text()
    assert text.count("<ALIGNABLE_ANNOTATION") == 8 and 'TIER_ID="vcm@FA1"' in text and 'TIME_VALUE="900"' in text
    from earshot.sources.tables import eaf_document

    (tmp_path / "back.eaf").write_text(eaf_document("a.wav", [(1, 0, 50, 0, 60)], speech=[(5, 20, "FA1", "hello <there>")]))
    assert values(read(spark, "eaf", str(tmp_path / "back.eaf")), "segment_onset", "segment_offset", "speaker_type", "transcription") == [(5, 20, "FEM", "hello <there>")]
    (tmp_path / "vet.csv").write_text("recording_filename,range_onset,range_offset\na.wav,2000,4000\n")
    run(data, "process", "vet", tmp_path / "vetted", "--ranges", tmp_path / "vet.csv")
    run(data, "process", "channels", tmp_path / "two", "--matrix", "1;0.5")
    from earshot.sources.audio import read_wav

    assert values(read_wav(spark, str(tmp_path / "vetted" / "a.wav")).selectExpr("aggregate(samples, 0D, (s, x) -> s + abs(x))"))[0][0] == 0
    assert read_wav(spark, str(tmp_path / "two" / "a.wav")).select("channel").distinct().count() == 2
    run(data, "rename-recording", "b.wav", "d.wav")
    assert values(data.segments().where("recording_filename = 'd.wav'"), "segment_onset") == [(100,)] and "d.wav" in (root / "metadata" / "recordings.csv").read_text()
    with pytest.raises(ValueError):
        data.rename_recording("gone.wav", "x.wav")
    run(data, "remove-file", "vtc", "a_0_4000.csv")
    assert values(data.index(), "recording_filename") == [("d.wav",)] and data.segments().count() == 1
    assert data.set_of(f"{data.root}/annotations/its/sub/raw/x/y.its") == "its/sub" and data.subsets("vtc") == []


def test_file_names_with_spaces_and_signs(spark, data, frame, tmp_path):
    raw = tmp_path / "set" / "annotations" / "odd" / "raw"
    raw.mkdir(parents=True)
    for name in ("a b.rttm", "é+%20.rttm"):
        (raw / name).write_text("SPEAKER x 1 0.1 0.2 <NA> <NA> FEM <NA> <NA>\n")
    rows = frame("set string, recording_filename string, range_onset bigint, range_offset bigint, raw_filename string, format string", ("odd", "a.wav", 0, 1000, "a b.rttm", "vtc_rttm"), ("odd", "b.wav", 0, 1000, "é+%20.rttm", "vtc_rttm"))
    assert data.import_annotations(rows).isEmpty() and values(data.segments(), "recording_filename", "segment_onset") == [("a.wav", 100), ("b.wav", 100)]


def test_anonymised_files(data, tmp_path):
    raw = tmp_path / "set" / "annotations" / "its" / "raw"
    raw.mkdir(parents=True)
    (raw / "a.its").write_text('<ITS>\n<Child id="secret" DOB="2020-05-06"/>\n</ITS>')
    (tmp_path / "r.yml").write_text('{"Child.id": "A1", "Child.DOB": "1000-01-01"}')
    run(data, "anonymize", "its", "its/anonymous", "--replacements", tmp_path / "r.yml")
    assert (tmp_path / "set" / "annotations" / "its" / "anonymous" / "raw" / "a.its").read_text() == '<ITS>\n<Child id="A1" DOB="1000-01-01"/>\n</ITS>'
