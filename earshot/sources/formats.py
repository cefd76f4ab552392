"""Readers of annotation formats: each gives raw_filename, segment_onset, segment_offset and the format's columns.

Line formats are parsed by Spark expressions; documents (XML, TextGrid, CHAT) are parsed whole, one task for each batch of
files. ``register`` adds a format.
"""

from __future__ import annotations

import json
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = {"csv": "csv", "vtc_rttm": "rttm", "vcm_rttm": "rttm", "alice": "txt", "its": "its", "TextGrid": "TextGrid", "eaf": "eaf", "cha": "cha", "w2v2-sm": "csv"}
READERS: dict[str, Callable[..., DataFrame]] = {}
_numbered = lambda stem, low, high: {f"{stem}{i}" for i in range(low, high + 1)}
#: Codes of speakers on tiers, by the type that they stand for; unknown adults, electronic voices and all else are NA.
SPEAKER_TYPES = {
    "CHI": {"CHI", "CHI*"},
    "FEM": _numbered("FA", 0, 8) | {"MOT*"},
    "MAL": _numbered("MA", 0, 5),
    "OCH": _numbered("C", 1, 2) | _numbered("FC", 1, 3) | _numbered("MC", 1, 5) | _numbered("UC", 1, 6) | {"MI1", "OC0"},
    "NA": _numbered("UA", 1, 6) | _numbered("EE", 1, 2) | {x + "E" for x in ("FA", "MA", "FC", "MC")},
}
_TYPE = {code: kind for kind, codes in SPEAKER_TYPES.items() for code in sorted(codes)}


def register(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in READERS:
            raise ValueError(f"there is a format {name}")
        READERS[name] = f
        return f

    return add


def read(spark: SparkSession, fmt: str, path: str | list[str], **options) -> DataFrame:
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt}; there are {sorted(READERS)}")
    return READERS[fmt](spark, path, **options)


def mapped(column: Column, table: Mapping[str, str], default: str | None = "NA") -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(default))


def speaker_type(column: str = "speaker_id") -> Column:
    """The type of speaker that a code stands for; NA for unknown ones."""
    return mapped(F.col(column), _TYPE)


def _file() -> Column:
    """The file's own name: Spark gives it as part of a URI, in which all but a plus is encoded."""
    return F.url_decode(F.replace(F.element_at(F.split(F.input_file_name(), "/"), -1), F.lit("+"), F.lit("%2B")))


@register("csv")
def csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Converted segments; NA counts as null."""
    raw = spark.read.csv(path, header=True, nullValue="")
    named = raw.select(*[F.when(F.col(f"`{c}`") != "NA", F.col(f"`{c}`")).alias(c) for c in raw.columns])
    out = named.withColumns({c: F.col(c).cast("double").cast("bigint") for c in ("segment_onset", "segment_offset")})
    return out if "raw_filename" in out.columns else out.withColumn("raw_filename", _file())


def _rttm(spark: SparkSession, path, source_file: str | None) -> DataFrame:
    """RTTM lines: ten fields parted by spaces; onset and offset are rounded half to even, in ms."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(*[F.get(f, i).alias(n) for i, n in enumerate(("type", "file", "chnl", "tbeg", "tdur", "ortho", "stype", "name", "conf", "lat"))], _file().alias("raw_filename"))
    begin, dur = F.col("tbeg").cast("double"), F.col("tdur").cast("double")
    out = rows.withColumns({"segment_onset": F.rint(begin * 1000).cast("bigint"), "segment_offset": F.rint((begin + dur) * 1000).cast("bigint")})
    return out if source_file is None else out.where(F.col("file") == source_file)


@register("vtc_rttm")
def vtc_rttm(spark: SparkSession, path: str | list[str], source_file: str | None = None) -> DataFrame:
    """Voice types. KCHI is the key child, CHI another child."""
    kind = mapped(F.col("name"), {"KCHI": "CHI", "CHI": "OCH", "FEM": "FEM", "MAL": "MAL", "OCH": "OCH"})
    return _rttm(spark, path, source_file).select("raw_filename", "segment_onset", "segment_offset", kind.alias("speaker_type"))


@register("vcm_rttm")
def vcm_rttm(spark: SparkSession, path: str | list[str], source_file: str | None = None) -> DataFrame:
    """Vocal maturity: cries, and canonical or non-canonical speech-like sounds of the child."""
    kind = mapped(F.col("name"), {"CRY": "CHI", "NCS": "CHI", "CNS": "CHI", "OTH": "CHI", "CHI": "OCH", "KCHI": "CHI", "FEM": "FEM", "MAL": "MAL", "OCH": "OCH"})
    vcm = mapped(F.col("name"), {"CRY": "Y", "NCS": "N", "CNS": "C", "OTH": "J"})
    return _rttm(spark, path, source_file).select("raw_filename", "segment_onset", "segment_offset", kind.alias("speaker_type"), vcm.alias("vcm_type"))


@register("alice")
def alice(spark: SparkSession, path: str | list[str], source_file: str | None = None) -> DataFrame:
    """Phoneme, syllable and word counts of clips, whose names end in onset and offset in tenths of ms."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(f, 0).alias("clip"), *[F.get(f, i).try_cast("double").alias(n) for i, n in enumerate(("phonemes", "syllables", "words"), 1)], _file().alias("raw_filename"))
    pattern = r"^(.*)_(?:0+)?([0-9]{1,})_(?:0+)?([0-9]{1,})\.wav$"
    rows = rows.where(F.col("clip").rlike(pattern))
    if source_file:
        rows = rows.where(F.col("clip").rlike(source_file))
    at = lambda i: F.floor(F.regexp_extract("clip", pattern, i).cast("bigint") / 10)
    return rows.select("raw_filename", at(2).alias("segment_onset"), at(3).alias("segment_offset"), "phonemes", "syllables", "words")


@register("w2v2-sm")
def w2v2(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Classes of clips named <recording>_<onset>_<offset>, in a table with id and class (0 to 4)."""
    pattern = r"^(.*)_([0-9]+)_([0-9]+)(?:\.wav)?$"
    rows = spark.read.csv(path, header=True)
    vcm = mapped(F.col("class").cast("string"), {"0": "C", "1": "N", "2": "J", "3": "Y", "4": "L"})
    part = lambda i: F.regexp_extract("id", pattern, i)
    return rows.where(F.col("id").rlike(pattern)).select(_file().alias("raw_filename"), part(2).cast("bigint").alias("segment_onset"), part(3).cast("bigint").alias("segment_offset"), F.lit("CHI").alias("speaker_type"), vcm.alias("vcm_type"))


def _documents(spark: SparkSession, path, parse: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """``parse`` on each whole file. Whole files are read, so none may exceed what a worker holds."""
    files = spark.read.text(path, wholetext=True).select(_file().alias("raw_filename"), "value")
    shape = "raw_filename string, segment_onset bigint, segment_offset bigint, " + columns
    names = [c.split()[0] for c in shape.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, *row) for name, text in zip(batch["raw_filename"], batch["value"]) for row in parse(text)]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.where(out.notna(), None)

    return files.mapInPandas(task, shape)


def write_documents(documents: DataFrame, folder: str) -> DataFrame:
    """Write each row's ``value`` as the file ``name`` below ``folder``; gives the names and sizes.

    Names may have folders. Listing takes a task a folder, so many files are best spread over several. Tasks write the files
    themselves: a partition for each file would have the driver move and list them one by one.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for name, value in zip(batch["name"], batch["value"]):
                final, content = f"{root}/{name}", value.encode()
                if (parent := final.rpartition("/")[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                # a task may run twice: the file appears whole or not at all; readers pass over names with an underscore
                part = f"{parent}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(content)
                fs.move(part, final)
                sizes.append(len(content))
            yield pd.DataFrame({"name": batch["name"], "bytes": pd.array(sizes, "int64")})

    return documents.select("name", "value").mapInPandas(task, "name string, bytes bigint")


def _seconds(text: str | None) -> float:
    m = re.fullmatch(r"PT?(\d+(?:\.\d+)?)S", text or "")
    return float(m[1]) if m else 0.0


def _marks(at: Mapping[str, str], kind: str) -> list[dict[str, float]]:
    """The numbered pairs startX1, endX1, startX2 and so on, up to the first gap."""
    out = []
    while (k := f"start{kind}{len(out) + 1}") in at:
        out.append({"start": _seconds(at[k]), "end": _seconds(at.get(k.replace("start", "end", 1)))})
    return out


def parse_its(text: str, recording_num: int | None = None) -> list[tuple]:
    """The segments of the conversations and pauses of LENA's recordings (or of one of them), in the file's order."""
    out = []
    for block in (b for r in ET.fromstring(text).iter("Recording") if recording_num in (None, int(r.get("num", 0))) for b in r if b.tag in ("Conversation", "Pause")):
        for s in block.findall("Segment"):
            at = s.attrib
            info = at["conversationInfo"].split("|")[1:-1] if at.get("conversationInfo") else []
            number = lambda *names: sum(float(at.get(n, 0)) for n in names)
            ms = lambda *names: float(int(1000 * sum(_seconds(at.get(n)) for n in names)))
            each = lambda pattern, *whose: [pattern.format(w) for w in whose]
            adults = ("femaleAdult", "maleAdult")
            utterances = [{"start": _seconds(next((v for k, v in u.attrib.items() if k.startswith("startUtt")), None)), "end": _seconds(next((v for k, v in u.attrib.items() if k.startswith("endUtt")), None))} for u in s.findall("UTT")] or _marks(at, "Utt")
            out.append((
                round(1000 * _seconds(at.get("startTime"))), round(1000 * _seconds(at.get("endTime"))), at.get("spkr"), _LENA.get(at.get("spkr", ""), "NA"),
                number(*each("{}WordCnt", *adults)), "pause" if block.tag == "Pause" else block.get("type"), int(block.get("num", 0)),
                *(info[i] if len(info) > i else "NA" for i in (0, 3, 6, 5)),
                number(*each("{}UttCnt", *adults, "child")), ms(*each("{}UttLen", *adults, "child")), ms(*each("{}NonSpeechLen", *adults)), number("average_dB"), number("peak_dB"), ms("childCryVfxLen"),
                *(json.dumps(x) for x in (utterances, _marks(at, "Cry"), _marks(at, "Vfx"))),
            ))
    return out


_LENA = {"CHN": "CHI", "CXN": "OCH", "FAN": "FEM", "MAN": "MAL"}


@register("its")
def its(spark: SparkSession, path: str | list[str], recording_num: int | None = None) -> DataFrame:
    """LENA's files; utterances, cries and vfxs become arrays of (start, end) in seconds."""
    columns = "lena_speaker string, speaker_type string, words double, lena_block_type string, lena_block_number bigint, lena_conv_status string, lena_response_count string, lena_conv_floor_type string, lena_conv_turn_type string, utterances_count double, utterances_length double, non_speech_length double, average_db double, peak_db double, child_cry_vfx_len double, utterances string, cries string, vfxs string"
    rows = _documents(spark, path, lambda text: parse_its(text, recording_num), columns)
    return rows.withColumns({c: spans(c) for c in ("utterances", "cries", "vfxs")})


def spans(column: str) -> Column:
    """An array of (start, end) from a list of dictionaries in single or double quotes."""
    return F.from_json(column, "array<struct<start double, end double>>")


_TIER = re.compile(r'item\s*\[\d+\]:(.*?)(?=item\s*\[\d+\]:|\Z)', re.DOTALL)
_INTERVAL = re.compile(r'intervals\s*\[\d+\]:?\s*xmin\s*=\s*([0-9.eE+-]+)\s*xmax\s*=\s*([0-9.eE+-]+)\s*text\s*=\s*"((?:[^"]|"")*)"')


def parse_textgrid(text: str) -> list[tuple]:
    """Intervals with a label, tier by tier; the tier Autre is left out."""
    out = []
    for tier in _TIER.findall(text):
        name = re.search(r'name\s*=\s*"((?:[^"]|"")*)"', tier)
        if name is None or name[1] == "Autre":
            continue
        for a, b, label in _INTERVAL.findall(tier):
            if not (label := label.replace('""', '"').strip()):
                continue
            one, zero = "1" in label, "0" in label
            out.append((round(1000 * float(a)), round(1000 * float(b)), name[1], _TYPE.get(name[1], "NA"), "1" if one and not zero else "0" if zero and not one else "NA"))
    return out


@register("TextGrid")
def textgrid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _documents(spark, path, parse_textgrid, "speaker_id string, speaker_type string, ling_type string")


def parse_eaf(text: str, new_tiers: Sequence[str] = ()) -> list[tuple]:
    """Alignable annotations of speakers' tiers, with the values of the tiers that depend on them (<label>@<tier>)."""
    root = ET.fromstring(text)
    slots = {s.get("TIME_SLOT_ID"): int(s.get("TIME_VALUE") or 0) for s in root.iter("TIME_SLOT")}
    rows: dict[str, dict] = {}
    parent: dict[str, str] = {}
    values: list[tuple[str, str, str]] = []
    for tier in root.iter("TIER"):
        name = tier.get("TIER_ID", "")
        label, _, ref = name.partition("@")
        for a in tier.iter("ALIGNABLE_ANNOTATION"):
            if name in _TYPE:
                rows[a.get("ANNOTATION_ID")] = {"on": slots.get(a.get("TIME_SLOT_REF1"), 0), "off": slots.get(a.get("TIME_SLOT_REF2"), 0), "who": name, "text": a.findtext("ANNOTATION_VALUE") or ""}
        for a in tier.iter("REF_ANNOTATION"):
            parent[a.get("ANNOTATION_ID")] = a.get("ANNOTATION_REF")
            if ref:
                values.append((a.get("ANNOTATION_ID"), label, a.findtext("ANNOTATION_VALUE") or ""))
    field = {"lex": "lex_type", "mwu": "mwu_type", "xds": "addressee", "vcm": "vcm_type", "msc": "msc_type"} | {t: t for t in new_tiers}
    for ident, label, value in values:
        seen = set()
        while ident in parent and ident not in seen:
            seen.add(ident)
            ident = parent[ident]
        if ident in rows and label in field:
            rows[ident][field[label]] = value
    more = ("lex_type", "mwu_type", "addressee", "vcm_type", "msc_type", *new_tiers)
    return [(r["on"], r["off"], r["who"], _TYPE[r["who"]], "1" if r["text"] not in ("", "0", "0.") else "0", r["text"], *(r.get(c, "NA") for c in more)) for r in rows.values()]


@register("eaf")
def eaf(spark: SparkSession, path: str | list[str], new_tiers: Sequence[str] = ()) -> DataFrame:
    columns = "speaker_id string, speaker_type string, ling_type string, transcription string, " + ", ".join(f"{c} string" for c in ("lex_type", "mwu_type", "addressee", "vcm_type", "msc_type", *new_tiers))
    return _documents(spark, path, lambda text: parse_eaf(text, new_tiers), columns)


_by_role = lambda table: {role: code for code, roles in table.items() for role in roles.split()}
#: Roles of a transcript's participants, by type of speaker and by code of addressee.
_ROLES = _by_role({"CHI": "Participant Target_Child", "FEM": "Female Grandmother Mother", "MAL": "Father Grandfather Male", "OCH": "Boy Brother Child Friend Girl Playmate Sibling Sister"})
_ADDRESSEES = _by_role({
    "T": "Target_Child",
    "C": "Brother Child Friend Playmate Sibling Sister",
    "A": "Adult Attorney Audience Caretaker Doctor Father Female Grandfather Grandmother Guest Host Investigator Justice Leader Male Member Mother Narrator Nurse Partner Speaker Student Target_Adult Teacher Teenager Visitor",
    "U": "Boy Environment Girl Group Participant Relative Uncertain Unidentified",
    "O": "LENA Media Other PlayRole Text",
})


def parse_cha(text: str) -> list[tuple]:
    """Timed utterances of a CHAT transcript, with the role of their speakers; lines without times are left out."""
    roles: dict[str, str] = {}
    out: list[list] = []
    lines: list[str] = []
    for line in text.splitlines():
        if line[:1] in ("\t", " ") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    for line in lines:
        if line.startswith("@Participants:"):
            for entry in line.split(":", 1)[1].split(","):
                if len(words := entry.split()) >= 2:
                    roles[words[0]] = words[-1]
        elif line.startswith("*"):
            who, _, said = line[1:].partition(":")
            times = re.search(r"\x15(\d+)_(\d+)\x15", said)
            said = re.sub(r"\x15\d+_\d+\x15", "", said).strip()
            words = [w for w in re.sub(r"\[[^\]]*\]|[<>()]", " ", said).split() if re.search(r"[^\W\d_]", w) and not w.startswith("&")]
            role = roles.get(who, "NA")
            out.append([int(times[1]), int(times[2]), who, role, _ROLES.get(role, "NA"), said, float(len(words)), "NA"] if times else [])
        elif line.startswith("%add:") and out and out[-1]:
            names = [x.strip() for x in line.split(":", 1)[1].split(",")]
            out[-1][7] = ",".join(sorted(_ADDRESSEES.get(roles.get(x, "NA"), "NA") for x in names))
    return [tuple(r) for r in out if r]


@register("cha")
def cha(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _documents(spark, path, parse_cha, "speaker_id string, speaker_role string, speaker_type string, transcription string, words double, addressee string")
