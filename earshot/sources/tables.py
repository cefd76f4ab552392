"""Dataset tables from CSV, and writers of tables and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.operators.interval import RANGE, REC, SEGMENT
from earshot.plans.manage import annotation_filename, keep_last, overlay, split_discarded
from earshot.schema import CHILDREN, NULLS, RECORDINGS, Rule


def read_table(spark: SparkSession, path: str | list[str], rules: Sequence[Rule] = (), enforce_types: bool = True, line: bool = False) -> DataFrame:
    """An index table: text columns, nulls by NULLS ("NA" stays a value), declared types if ``enforce_types``.

    A value that isn't of its type raises when it is read. ``line`` adds _line, the row's line in its file, for one small file.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="")
    declared = {r.name: r.type for r in rules}
    value = lambda c: F.when(~F.col(f"`{c}`").isin(*NULLS), F.col(f"`{c}`"))
    out = raw.select(*[(value(c).cast(declared[c]) if enforce_types and c in declared else value(c)).alias(c) for c in raw.columns])
    if line:
        out = out.withColumn("_id", F.monotonically_increasing_id()).withColumn("_line", F.row_number().over(Window.orderBy("_id")).cast("bigint") + 1).drop("_id")
    return out


def read_dataset(spark: SparkSession, root: str, overlays: bool = True) -> dict[str, DataFrame]:
    """children, recordings, and their discarded rows, with the overlays of metadata/children/ and metadata/recordings/ applied."""
    out = {}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for table, rules, key in (("children", CHILDREN, "child_id"), ("recordings", RECORDINGS, REC)):
        df = read_table(spark, f"{root}/metadata/{table}.csv", rules)
        folder = hadoop(f"{root}/metadata/{table}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if overlays and fs.exists(folder):
            found, it = [], fs.listFiles(folder, True)
            while it.hasNext():
                if (path := it.next().getPath().toString()).endswith(".csv"):
                    found.append(path)
            names = [p.rsplit("/", 1)[1] for p in found]
            if twice := sorted({n for n in names if names.count(n) > 1}):
                raise ValueError(f"overlays of the same name: {twice}")
            # the first by name wins, so it comes last
            df = overlay(df, [read_table(spark, p, rules) for p in sorted(found, key=lambda p: p.rsplit("/", 1)[1], reverse=True)], key)
        out[table], out[f"discarded_{table}"] = split_discarded(df)
    return out


def read_documentation(spark: SparkSession, root: str, tables: Sequence[str] = ("children", "recordings", "annotations")) -> DataFrame:
    """The documentation of all tables, with the table's name."""
    found = [read_table(spark, f"{root}/docs/{t}.csv").withColumn("table", F.lit(t)) for t in tables]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def write_segments(segments: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, a folder for each set, a recording's segments together and in order of time, so that readers prune by set and recording."""
    order = [REC, *SEGMENT, *(["speaker_type"] if "speaker_type" in segments.columns else [])]
    segments.repartition("set", REC).sortWithinPartitions("set", *order).write.partitionBy("set").mode(mode).parquet(path)


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The annotation index, with file names, one row for each key."""
    named = index if "annotation_filename" in index.columns else index.withColumn("annotation_filename", annotation_filename())
    named = keep_last(named) if "imported_at" in named.columns else named
    named.orderBy("set", REC, *RANGE).write.mode(mode).parquet(path)


def write_recordings(kept: DataFrame, discarded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Kept and discarded rows in one table, the latter with discard 1."""
    kept.unionByName(discarded.withColumn("discard", F.lit("1")), allowMissingColumns=True).write.mode(mode).csv(path, header=True)


def eaf_templates(samples: DataFrame, context_ms: int = 0) -> DataFrame:
    """For each sampled range the code and context spans of an annotation template, numbered within the recording."""
    nth = F.row_number().over(Window.partitionBy(REC).orderBy(*SEGMENT))
    return samples.select(REC, nth.alias("code_num"), F.col("segment_onset").alias("code_onset"), F.col("segment_offset").alias("code_offset"), F.greatest(F.col("segment_onset") - context_ms, F.lit(0)).alias("context_onset"), (F.col("segment_offset") + context_ms).alias("context_offset"))


#: Tiers of a template: the coded and context spans, what is coded about a span, and a tier for each speaker with dependent ones.
SPAN_TIERS, NOTE_TIERS, DEPENDENT = ("code", "context"), ("code_num", "on_off", "notes"), ("xds", "vcm", "lex", "mwu")


def eaf_document(recording: str, spans: Sequence[tuple[int, int, int, int, int]], speakers: Sequence[str] = ("CHI", "FA1", "MA1"), speech: Sequence[tuple[int, int, str, str]] = ()) -> str:
    """An ELAN document: (number, code onset, code offset, context onset, context offset) spans, empty tiers for the speakers, and any (onset, offset, speaker, text) to begin with."""
    import xml.etree.ElementTree as ET

    root = ET.Element("ANNOTATION_DOCUMENT", AUTHOR="", DATE="1970-01-01T00:00:00+00:00", FORMAT="3.0", VERSION="3.0")
    head = ET.SubElement(root, "HEADER", MEDIA_FILE="", TIME_UNITS="milliseconds")
    ET.SubElement(head, "MEDIA_DESCRIPTOR", MEDIA_URL=f"file:///{recording}", MIME_TYPE="audio/x-wav")
    order = ET.SubElement(root, "TIME_ORDER")
    count = {"slot": 0, "annotation": 0}

    def slot(ms: int) -> str:
        count["slot"] += 1
        ET.SubElement(order, "TIME_SLOT", TIME_SLOT_ID=f"ts{count['slot']}", TIME_VALUE=str(int(ms)))
        return f"ts{count['slot']}"

    def tier(name: str, rows: Sequence[tuple[int, int, str]] = (), parent: str | None = None) -> None:
        out = ET.SubElement(root, "TIER", TIER_ID=name, LINGUISTIC_TYPE_REF="dependent" if parent else "spans", **({"PARENT_REF": parent} if parent else {}))
        for on, off, text in rows:
            count["annotation"] += 1
            a = ET.SubElement(ET.SubElement(out, "ANNOTATION"), "ALIGNABLE_ANNOTATION", ANNOTATION_ID=f"a{count['annotation']}", TIME_SLOT_REF1=slot(on), TIME_SLOT_REF2=slot(off))
            ET.SubElement(a, "ANNOTATION_VALUE").text = text

    tier("code", [(on, off, str(n)) for n, on, off, _, _ in spans])
    tier("context", [(on, off, str(n)) for n, _, _, on, off in spans])
    tier("code_num", [(on, off, str(n)) for n, on, off, _, _ in spans])
    tier("on_off", [(on, off, f"{on}_{off}") for _, on, off, _, _ in spans])
    tier("notes")
    for who in dict.fromkeys([*speakers, *(s[2] for s in speech)]):
        tier(who, [(on, off, text) for on, off, name, text in speech if name == who])
        for kind in DEPENDENT:
            tier(f"{kind}@{who}", parent=who)
    ET.SubElement(root, "LINGUISTIC_TYPE", GRAPHIC_REFERENCES="false", LINGUISTIC_TYPE_ID="spans", TIME_ALIGNABLE="true")
    ET.SubElement(root, "LINGUISTIC_TYPE", GRAPHIC_REFERENCES="false", LINGUISTIC_TYPE_ID="dependent", TIME_ALIGNABLE="false", CONSTRAINTS="Symbolic_Association")
    ET.SubElement(root, "CONSTRAINT", STEREOTYPE="Symbolic_Association", DESCRIPTION="1-1 association with a parent annotation")
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def eaf_documents(templates: DataFrame, speakers: Sequence[str] = ("CHI", "FA1", "MA1"), speech: DataFrame | None = None) -> DataFrame:
    """recording_filename and its ELAN document, from the rows of ``eaf_templates``; ``speech`` are segments with speaker_id and transcription to begin with, by the spans that they lie in."""
    spans = templates.groupBy(REC).agg(F.array_sort(F.collect_list(F.struct("code_num", "code_onset", "code_offset", "context_onset", "context_offset"))).alias("spans"))
    said = None
    if speech is not None:
        inside = speech.join(templates.select(REC, "code_onset", "code_offset"), REC).where("segment_onset < code_offset and code_onset < segment_offset").select(REC, *SEGMENT, "speaker_id", F.coalesce("transcription", F.lit("")).alias("said")).distinct()
        said = inside.groupBy(REC).agg(F.array_sort(F.collect_list(F.struct(*SEGMENT, "speaker_id", "said"))).alias("speech"))
    both = spans.withColumn("speech", F.lit(None).cast("array<struct<a bigint, b bigint, c string, d string>>")) if said is None else spans.join(said, REC, "left")

    def task(batches):
        for batch in batches:
            rows = lambda x: [tuple(r.values()) for r in x] if x is not None else []
            texts = [eaf_document(r, rows(a), speakers, rows(b)) for r, a, b in zip(batch[REC], batch["spans"], batch["speech"])]
            yield batch[[REC]].assign(document=texts)

    return both.mapInPandas(task, f"{REC} string, document string")
