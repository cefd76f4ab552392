"""The command line: python -m earshot COMMAND ROOT ... Each command is a thin wrapper of a function of the library."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import __version__
from earshot.functions.metrics import aclew_bundle, lena_bundle
from earshot.operators import audio, conversations, interval, sampling
from earshot.operators.interval import REC
from earshot.plans import manage
from earshot.plans.dataset import Dataset, dump_yaml, load_yaml
from earshot.plans.metrics import extract_spec
from earshot.session import session
from earshot.sources.audio import read_wav, write_wav
from earshot.sources.tables import eaf_documents, eaf_templates, read_table


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="earshot", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *positional: str, **options: object) -> None:
        p = sub.add_parser(name, help=text)
        for x in ("root", *positional):
            p.add_argument(x)
        for k, default in options.items():
            flag = "--" + k.replace("_", "-")
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=int if isinstance(default, int) else str)

    add("init", "make an empty dataset")
    add("validate", "list what breaks the rules; exit status 1 if there are errors")
    add("overview", "counts, durations, ages and devices")
    add("explain", "what a column means", "column")
    add("sets-metadata", "the sets, with their metadata and annotated time")
    add("import-annotations", "import what a CSV table lists", "table", overwrite=False)
    add("automated-import", "import a file of each recording as a whole", "set", "format", overwrite=False)
    add("derive-annotations", "make a set from another: conversations, remove-overlaps or cva", "derivation", "input_set", "output_set")
    add("merge-annotations", "one set with the columns of two", "left", "right", "output", left_columns="speaker_type", right_columns="")
    add("intersect-annotations", "the index cut to what all sets annotate, as CSV", "sets", "output")
    add("remove-annotations", "remove a set", "set")
    add("rename-annotations", "rename a set", "old", "new")
    add("metrics", "metrics by a specification in YAML or JSON, or by a bundle", "output", spec="", lena="", aclew="", alice="", vcm="", by=REC)
    add("conversations", "summaries of the conversations of a set", "set", "output", spec="")
    add("sample", "periodic, random, words, turns, vocs, conversations, energy or custom", "sampler", "output", set="", length=60_000, period=3_600_000, offset=0, count=10, by=REC, seed=0, threshold="0.8", low="", high="", table="", exclude="")
    add("rename-recording", "rename a recording everywhere", "old", "new")
    add("compute-durations", "durations of the recordings from their WAV files", overwrite=False)
    add("compare-recordings", "the mean difference of two recordings' samples", "first", "second")
    add("process", "vet or channels: write changed recordings to a folder", "processor", "output", ranges="", matrix="")
    add("anonymize", "LENA files of a set with other values of attributes", "input_set", "output_set", replacements="")
    add("eaf-builder", "ELAN templates for sampled ranges", "segments", "output", context=0, speakers="CHI,FA1,MA1", speech="")
    add("remove-file", "remove one annotation file", "set", "annotation_filename")
    return top


def write(df: DataFrame, path: str, parameters: dict) -> None:
    """CSV in a folder, with the parameters beside it, from which the same can be run again."""
    df.write.mode("overwrite").csv(path, header=True)
    folder, _, name = path.rstrip("/").rpartition("/")
    Dataset(df.sparkSession, folder or ".").write_text(f"{name}.parameters.yml", dump_yaml({"package_version": __version__, "date": datetime.datetime.now().isoformat(), "parameters": parameters}))


def parameters_of(data: Dataset, path: str) -> dict:
    text = "\n".join(r[0] for r in data.spark.read.text(path).collect())
    found = load_yaml(text)
    return found.get("parameters", found)


def ranged(spark: SparkSession, path: str, cols: tuple[str, str]) -> DataFrame:
    """Recordings and ranges from CSV."""
    return read_table(spark, path).select(REC, *[F.col(c).cast("bigint").alias(c) for c in cols])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session("earshot " + a.command)
    data = Dataset.create(spark, a.root) if a.command == "init" else Dataset(spark, a.root)
    names = lambda text: [x for x in text.split(",") if x]
    if a.command == "validate":
        found = data.validate().cache()
        found.show(1000, False)
        return int(not found.where("severity = 'error'").isEmpty())
    if a.command == "overview":
        t = data.tables()
        manage.overview(t["recordings"], t["children"]).show(truncate=False, vertical=True)
        manage.devices(t["recordings"]).show(truncate=False)
    elif a.command == "explain":
        data.explain(a.column).show(truncate=False, vertical=True)
    elif a.command == "sets-metadata":
        manage.sets_report(data.index(), data.set_metadata()).withColumn("duration", manage.printable("duration", "h")).show(1000, False)
    elif a.command in ("import-annotations", "automated-import"):
        if a.command == "import-annotations":
            rows = read_table(spark, a.table).withColumns({c: F.col(c).cast("bigint") for c in ("range_onset", "range_offset")})
            rows = rows.withColumn("time_seek", F.col("time_seek").cast("bigint")) if "time_seek" in rows.columns else rows
        else:
            from earshot.sources.formats import EXTENSIONS

            rows = manage.full_ranges(data.tables()["recordings"], a.set, a.format, EXTENSIONS[a.format])
        bad = data.import_annotations(rows, a.overwrite)
        bad.show(1000, False)
        return int(not bad.isEmpty())
    elif a.command == "derive-annotations":
        data.derive(a.input_set, a.output_set, a.derivation)
    elif a.command == "merge-annotations":
        data.merge_sets(a.left, a.right, names(a.left_columns), names(a.right_columns), a.output)
    elif a.command == "intersect-annotations":
        write(interval.intersect_sets(data.index(), names(a.sets)), a.output, {"sets": a.sets})
    elif a.command == "remove-annotations":
        data.remove_set(a.set)
    elif a.command == "rename-annotations":
        data.rename_set(a.old, a.new)
    elif a.command == "metrics":
        spec = parameters_of(data, a.spec) if a.spec else {"by": a.by, "metrics_list": lena_bundle(a.lena) if a.lena else aclew_bundle(a.aclew, a.alice or None, a.vcm or None)}
        t = data.tables()
        write(extract_spec(spec, data.segments(), data.index(), t["recordings"], children=t["children"]), a.output, spec)
    elif a.command == "conversations":
        spec = parameters_of(data, a.spec) if a.spec else {"features": conversations.STANDARD}
        rows = data.annotated([a.set])
        write(conversations.summarise(rows if "conv_count" in rows.columns else conversations.conversation_ids(rows), spec["features"]), a.output, spec)
    elif a.command == "rename-recording":
        data.rename_recording(a.old, a.new)
    elif a.command == "compute-durations":
        data.compute_durations(a.overwrite)
    elif a.command == "remove-file":
        data.remove_files(data.index().where((F.col("set") == a.set) & (F.col("annotation_filename") == a.annotation_filename)))
    elif a.command == "compare-recordings":
        audio.compare(read_wav(spark, [f"{data.root}/recordings/{x}" for x in (a.first, a.second)]), a.first, a.second).show(truncate=False)
    elif a.command == "process":
        signal = read_wav(spark, f"{data.root}/recordings/*")
        if a.processor == "vet":
            done = audio.vet(signal, ranged(spark, a.ranges, interval.RANGE))
        elif a.processor == "channels":
            done = audio.map_channels(signal, [[float(x) for x in row.split(",")] for row in a.matrix.split(";")])
        else:
            raise SystemExit(f"unknown processor {a.processor}")
        write_wav(done, a.output).count()
    elif a.command == "anonymize":
        pairs = {tuple(k.split(".", 1)): v for k, v in parameters_of(data, a.replacements).items()}
        for name in (n for n in data._listed(f"annotations/{a.input_set}/raw") if n.endswith(".its")):
            lines = manage.anonymise(spark.read.text(f"{data.root}/annotations/{a.input_set}/raw/{name}", wholetext=True), pairs)
            data.write_text(f"annotations/{a.output_set}/raw/{name}", lines.first()[0])
    elif a.command == "eaf-builder":
        spans = eaf_templates(ranged(spark, a.segments, interval.SEGMENT).distinct(), a.context)
        speech = data.annotated([a.speech]) if a.speech else None
        documents = eaf_documents(spans, names(a.speakers), speech if speech is None or "transcription" in speech.columns else speech.withColumn("transcription", F.lit("")))
        out = Dataset(spark, a.output)
        for r in documents.toLocalIterator():
            out.write_text(f"{r[REC].rsplit('.', 1)[0]}.eaf", r["document"])
    elif a.command == "sample":
        rec = data.tables()["recordings"]
        if a.sampler == "custom":
            found = ranged(spark, a.table, interval.SEGMENT)
        elif a.sampler == "energy":
            signal = audio.whole(read_wav(spark, f"{data.root}/recordings/*"))
            rate = signal.select("rate").first()["rate"]
            number = lambda x: float(x) if x else None
            windows = sampling.window_energy(signal, rate, a.length, a.period, a.offset, number(a.low), number(a.high))
            found = sampling.energy_detection(windows, a.count, float(a.threshold), seed=a.seed).select(REC, *interval.SEGMENT)
        elif a.sampler == "periodic":
            found = sampling.periodic(rec.withColumn("start_ts", F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", "date_iso", "start_time"), F.lit("yyyy-MM-dd H:mm")))), a.length, a.period, a.offset, a.by)
        else:
            rows = data.annotated([a.set]) if a.by == REC else data.annotated([a.set]).join(rec.select(REC, a.by), REC)
            found = sampling.random_vocalizations(rows, a.count, None, a.by, a.seed) if a.sampler == "random" else sampling.top_conversations(rows, a.count, by=a.by) if a.sampler == "conversations" else sampling.high_volubility(rows, a.sampler, a.length, a.count, by=a.by)
        write(interval.exclude(found, ranged(spark, a.exclude, interval.SEGMENT)) if a.exclude else found, a.output, vars(a))
    return 0


if __name__ == "__main__":
    sys.exit(main())
