"""Declared schemas and column rules of the dataset's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE, TIMES = ("yyyy-MM-dd",), ("H:mm:ss", "H:mm")
#: Strings that stand for null in index tables. NA isn't one of them: it is a value there.
NULLS = ("", "-1.#IND", "1.#QNAN", "1.#IND", "-1.#QNAN", "#N/A N/A", "#N/A", "N/A", "n/a", "#NA", "NULL", "null", "NaN", "-NaN", "nan", "-nan", "<NA>")


@dataclass(frozen=True)
class Rule:
    """One column: of ``check``, ``choices``, ``formats`` and ``regex`` the first that is given applies."""

    name: str
    required: bool = False
    type: T.DataType = T.StringType()
    choices: tuple[str, ...] = ()
    regex: str | None = None
    formats: tuple[str, ...] = ()
    check: Callable[[Column], Column] | None = None
    unique: bool = False
    filename: bool = False

    def ok(self) -> Column | None:
        """Whether the value satisfies the rule; None where there is nothing to check."""
        c = F.col(f"`{self.name}`")
        text = c.cast("string")
        if self.check is not None:
            return self.check(c)
        if self.choices:
            return text.isin(*self.choices)
        if self.formats:
            ok = F.lit(False)
            for f in self.formats:
                ok = ok | F.try_to_timestamp(text, F.lit(f)).isNotNull()
            return ok
        if self.regex:
            return text.rlike(rf"^(?:{self.regex})\z")
        return None


def struct(rules: tuple[Rule, ...]) -> T.StructType:
    return T.StructType([T.StructField(r.name, r.type) for r in rules])


LONG, DOUBLE = T.LongType(), T.DoubleType()
_counting = lambda c: c.cast("string").rlike(r"^\d+(\.0*)?\z")

CHILDREN = (
    Rule("experiment", True, regex=r"\S[\s\S]*"),
    Rule("child_id", True, unique=True),
    Rule("child_dob", True, formats=DATE),
    Rule("location_id"),
    Rule("child_sex", choices=("m", "f", "M", "F")),
    Rule("language"),
    Rule("languages"),
    Rule("mat_ed"),
    Rule("fat_ed"),
    Rule("car_ed"),
    Rule("monoling", choices=("Y", "N", "NA")),
    Rule("monoling_criterion"),
    Rule("normative", choices=("Y", "N", "NA")),
    Rule("normative_criterion"),
    Rule("mother_id"),
    Rule("father_id"),
    Rule("order_of_birth", regex=r"\d+(\.0)?"),
    Rule("n_of_siblings", regex=r"\d+(\.0)?"),
    Rule("household_size", regex=r"\d+(\.0)?"),
    Rule("dob_criterion", choices=("extrapolated", "exact")),
    Rule("dob_accuracy", choices=("exact", "estimated", "other")),
    Rule("discard", choices=("0", "1")),
)
RECORDINGS = (
    Rule("experiment", True),
    Rule("child_id", True),
    Rule("date_iso", True, formats=DATE),
    Rule("start_time", True, formats=TIMES),
    Rule("recording_device_type", True, choices=("usb", "olympus", "lena", "babylogger", "izyrec", "unknown")),
    Rule("recording_filename", True, unique=True, filename=True),
    Rule("duration", type=LONG, regex=r"([0-9]+)"),
    Rule("session_id"),
    Rule("session_offset", regex=r"[0-9]+"),
    Rule("recording_device_id"),
    Rule("experimenter"),
    Rule("location_id"),
    Rule("its_filename", filename=True),
    Rule("upl_filename", filename=True),
    Rule("trs_filename", filename=True),
    Rule("lena_id"),
    Rule("lena_recording_num"),
    Rule("might_feature_gaps"),
    Rule("start_time_accuracy", choices=("minute", "hour", "reliable", "unknown")),
    Rule("noisy_setting"),
    Rule("notes"),
    Rule("discard", choices=("0", "1")),
)
INDEX = (
    Rule("set", True),
    Rule("recording_filename", True, filename=True),
    Rule("time_seek", type=LONG, regex=r"(\-?)([0-9]+)"),
    Rule("range_onset", True, LONG, regex=r"[0-9]+"),
    Rule("range_offset", True, LONG, regex=r"[0-9]+"),
    Rule("raw_filename", True),
    Rule("format", choices=("csv", "vtc_rttm", "vcm_rttm", "alice", "its", "TextGrid", "eaf", "cha", "w2v2-sm", "NA")),
    Rule("filter"),
    Rule("annotation_filename", filename=True),
    Rule("imported_at", formats=("yyyy-MM-dd HH:mm:ss",)),
    Rule("package_version", regex=r"[0-9]+\.[0-9]+\.[0-9]+.*"),
    Rule("error"),
    Rule("merged_from"),
)
_COUNTS = ("phonemes", "syllables", "words")
SEGMENTS = (
    Rule("raw_filename", True),
    Rule("segment_onset", True, LONG, regex=r"[0-9]+"),
    Rule("segment_offset", True, LONG, regex=r"[0-9]+"),
    Rule("speaker_id"),
    Rule("speaker_type", choices=("FEM", "MAL", "CHI", "OCH", "NA")),
    Rule("ling_type", choices=("1", "0", "NA")),
    Rule("vcm_type", choices=("C", "N", "Y", "L", "J", "U", "NA")),
    Rule("lex_type", choices=("W", "0", "NA")),
    Rule("mwu_type", choices=("M", "1", "0", "NA")),
    Rule("msc_type"),
    Rule("gra_type"),
    Rule("addressee"),
    Rule("transcription"),
    *(Rule(c, type=DOUBLE, regex=r"\d+(\.\d+)?") for c in _COUNTS),
    Rule("lena_block_type", choices=("pause", "CM", "CIC", "CIOCX", "CIOCAX", "AMF", "AICF", "AIOCF", "AIOCCXF", "AMM", "AICM", "AIOCM", "AIOCCXM", "XM", "XIC", "XIOCA", "XIOCC", "XIOCAC")),
    Rule("lena_block_number", type=LONG, regex=r"(\d+(\.\d+)?)"),
    Rule("lena_conv_status", choices=("BC", "RC", "EC")),
    Rule("lena_response_count", regex=r"(\d+(\.\d+)?)"),
    Rule("lena_conv_floor_type", choices=("FI", "FH")),
    Rule("lena_conv_turn_type", choices=("TIFI", "TIMI", "TIFR", "TIMR", "TIFE", "TIME", "NT")),
    Rule("lena_speaker", choices=("TVF", "FAN", "OLN", "SIL", "NOF", "CXF", "OLF", "CHF", "MAF", "TVN", "NON", "CXN", "CHN", "MAN", "FAF")),
    Rule("utterances_count", type=DOUBLE, regex=r"(\d+(\.\d+)?)"),
    Rule("utterances_length", type=DOUBLE, regex=r"(\d+(\.\d+)?)"),
    Rule("non_speech_length", type=DOUBLE, regex=r"(\d+(\.\d+)?)"),
    Rule("average_db", type=DOUBLE, regex=r"(\-?)(\d+(\.\d+)?)"),
    Rule("peak_db", type=DOUBLE, regex=r"(\-?)(\d+(\.\d+)?)"),
    Rule("child_cry_vfx_len", type=DOUBLE, regex=r"(\d+(\.\d+)?)"),
    Rule("utterances"),
    Rule("cries"),
    Rule("vfxs"),
)
SET_METADATA = ("segmentation", "segmentation_type", "method", "sampling_method", "sampling_target", "sampling_count", "sampling_unit_duration", "recording_selection", "participant_selection", "annotator_name", "annotator_experience", "annotation_algorithm_name", "annotation_algorithm_publication", "annotation_algorithm_version", "annotation_algorithm_repo", "date_annotation", "has_speaker_type", "has_transcription", "has_interactions", "has_acoustics", "has_addressee", "has_vcm_type", "has_words", "notes", "metannots")
#: has_X is Y where a set has one of these combinations of columns.
CONTENT = {
    "has_speaker_type": (("speaker_type",), ("speaker_id",)),
    "has_transcription": (("transcription",),),
    "has_interactions": (("is_CT",), ("conv_count",), ("lena_conv_turn_type",)),
    "has_acoustics": (("mean_pitch_semitone",), ("average_db",)),
    "has_addressee": (("addressee",), ("cva",)),
    "has_vcm_type": (("vcm_type",),),
    "has_words": (("words",),),
}


def content_of(columns: list[str]) -> dict[str, str]:
    """has_X flags of a set, from the columns of its segments."""
    return {k: "Y" for k, ways in CONTENT.items() if any({*w} <= {*columns} for w in ways)}
