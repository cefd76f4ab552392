from __future__ import annotations

import pytest
from conftest import values
from pyspark.sql import functions as F
from test_interval import SEG, clip  # noqa: F401

from earshot.functions import features
from earshot.operators import conversations, derive


def test_file_order_decides(clip):  # noqa: F811
    got = values(conversations.conversation_ids(clip), "row_no", "iti", "delay", "is_CT", "conv_count")
    assert [(r[3], r[4]) for r in got] == [(False, 1), *[(True, 1)] * 3, (False, 2), *[(True, 2)] * 8]
    assert got[0][1:3] == (None, None) and got[4][1:3] == (-1218, -579) and got[12][1:3] == (246, 599)


def test_summary(clip):  # noqa: F811
    got = [r.asDict() for r in conversations.summarise(conversations.conversation_ids(clip)).orderBy("conv_count").collect()]
    first, second = got
    assert (first["conversation_onset"], first["conversation_offset"], first["voc_count"], first["interval_last_conv"]) == (0, 1421, 4, None)
    assert (second["conversation_onset"], second["conversation_offset"], second["interval_last_conv"]) == (203, 3987, 203 - 1421)
    assert (first["initiator"], first["finisher"], second["CHI_voc_count"], first["CHI_voc_dur"]) == ("CHI", "MAL", 3, 342)
    assert len(features.STANDARD) == 11


def test_feature_in_pandas(clip):  # noqa: F811
    features.register_pandas("speakers_in_order", lambda df, joined: joined.join(df["speaker_type"].dropna()), "string")
    try:
        rows = conversations.conversation_ids(clip)
        got = conversations.summarise(rows, [{"callable": "who_initiated", "name": "i"}, {"callable": "speakers_in_order", "name": "all", "joined": "-"}]).orderBy("conv_count").collect()
        assert [r["all"].split("-")[0] for r in got] == [r["i"] for r in got] and len(got[0]["all"].split("-")) == got[0]["voc_count"]
        with pytest.raises(ValueError):
            features.register_pandas("who_initiated", len)
    finally:
        features.IN_PANDAS.pop("speakers_in_order")


@pytest.mark.parametrize("speakers, kind", [("FEM MAL", "overheard"), ("CHI FEM", "dyadic_FEM"), ("CHI MAL", "dyadic_MAL"), ("CHI OCH", "peer"), ("CHI FEM MAL", "parent"), ("CHI FEM OCH", "triadic_FEM"), ("CHI MAL OCH", "triadic_MAL"), ("CHI FEM MAL OCH", "multiparty"), ("CHI CHI", None)])
def test_types_of_conversations(frame, speakers, kind):
    rows = [(i, "x", i * 10, i * 10 + 5, s, 1) for i, s in enumerate(speakers.split())]
    df = frame(SEG + ", conv_count int", *rows)
    specs = [{"callable": "assign_conv_type", "name": "k"}, {"callable": "participants", "name": "p"}, {"callable": "voc_dur_contribution", "name": "c", "speaker": "CHI"}, {"callable": "voc_speaker_dur", "name": "d", "speaker": "CHI"}, {"callable": "is_speaker", "name": "i", "speaker": "OCH"}]
    r = conversations.summarise(df, specs).first()
    who = speakers.split()
    assert (r["k"], r["p"], r["i"]) == (kind, "/".join(dict.fromkeys(who)), "OCH" in who)
    assert (r["c"], r["d"]) == ((who.count("CHI") / len(who), who.count("CHI") * 5) if "CHI" in who else (None, None))


def test_addressing_the_child(clip):  # noqa: F811
    clean = derive.remove_overlaps(clip).withColumn("row_no", F.col("segment_onset"))
    assert [r[1] for r in values(derive.cva(clean, max_interval=5000), "row_no", "cva")] == ["NA", "Y", "N", "Y", "NA", "Y", "N", "Y", "NA"]


def test_addressing_by_neighbours(frame):
    df = frame(SEG, (0, "x", 0, 10, "FEM"), (1, "x", 20, 30, "FEM"), (2, "x", 35, 40, "MAL"), (3, "x", 9000, 9010, "CHI"), (4, "x", 99_000, 99_100, "MAL"), (5, "y", 0, 1, "FEM"), (6, "x", 200_000, 200_001, None))
    got = dict(values(derive.cva(df, "P"), "row_no", "cva"))
    # 0: one near neighbour of its type; 1: MAL is nearer; 2: the child is next; 4: beside the child; 5: alone
    assert (got[0], got[1], got[2], got[3], got[4], got[5]) == ("Y", "N", "Y", "NA", "Y", "Y")
    with pytest.raises(ValueError):
        derive.cva(df, "Q")


def test_derivations_cut_to_ranges(frame):
    seg = frame(SEG + ", set string, range_onset bigint, range_offset bigint", (0, "x", 0, 100, "CHI", "a", 20, 90), (1, "x", 120, 130, "FEM", "a", 20, 90))
    idx = frame("set string, recording_filename string, range_onset bigint, range_offset bigint", ("a", "x", 20, 90))
    rows, index = derive.derive(seg, idx, "a", "a/c", "conversations")
    assert values(rows, "set", "segment_onset", "segment_offset") == [("a/c", 20, 90)] and values(index, "set") == [("a/c",)]
    with pytest.raises(ValueError):
        derive.derive(seg, idx, "a", "b", lambda df: df.drop("segment_onset"))
