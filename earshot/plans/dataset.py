"""A dataset below one root: metadata tables as CSV, the annotation index and segments as Parquet, set metadata as YAML."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot import __version__
from earshot.operators import derive, interval, validate
from earshot.operators.interval import RANGE, REC
from earshot.plans import manage
from earshot.schema import CHILDREN, INDEX, RECORDINGS, SEGMENTS, content_of
from earshot.sources import formats
from earshot.sources.audio import durations
from earshot.sources.tables import read_dataset, read_table


def load_yaml(text: str) -> dict:
    """A YAML mapping; without the library JSON and flat "key: value" lines are understood."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        try:
            return json.loads(text)
        except ValueError:
            pairs = (line.partition(":") for line in text.splitlines() if ":" in line and not line.lstrip().startswith("#"))
            return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


def dump_yaml(values: Mapping) -> str:
    """JSON is YAML too."""
    return json.dumps(values, indent=1, ensure_ascii=False, default=str) + "\n"


class Dataset:
    """Tables and bookkeeping. Each change of annotations writes new files and then points at them, so readers never see half of one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Dataset:
        self = cls(spark, root)
        for folder in ("metadata", "recordings", "annotations", "extra", "docs"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))
        return self

    def tables(self) -> dict[str, DataFrame]:
        return read_dataset(self.spark, self.root)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{path}"))

    def read_text(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{path}").collect())

    def write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{path}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _current(self, what: str) -> str | None:
        return self.read_text(f"annotations/{what}.current").strip() if self.exists(f"annotations/{what}.current") else None

    def _replace(self, what: str, df: DataFrame) -> None:
        name = f"annotations/{what}-{uuid.uuid4().hex}"
        rows = df.repartition("set", REC).sortWithinPartitions("set", REC)
        (rows.write.partitionBy("set") if what == "segments" else rows.write).parquet(f"{self.root}/{name}")
        before = self._current(what)
        self.write_text(f"annotations/{what}.current", name)
        if before:
            self._fs.delete(self._path(f"{self.root}/{before}"), True)

    def index(self) -> DataFrame:
        """The annotation index; without any the schema alone."""
        if (at := self._current("index")) is None:
            return self.spark.createDataFrame([], ", ".join(f"{r.name} {r.type.simpleString()}" for r in INDEX))
        return self.spark.read.parquet(f"{self.root}/{at}")

    def segments(self) -> DataFrame:
        if (at := self._current("segments")) is None:
            return self.spark.createDataFrame([], f"set string, {REC} string, annotation_filename string, " + ", ".join(f"{r.name} {r.type.simpleString()}" for r in SEGMENTS))
        return self.spark.read.parquet(f"{self.root}/{at}")

    def _store(self, index: DataFrame, segments: DataFrame) -> None:
        self._replace("segments", segments)
        self._replace("index", index)

    def import_annotations(self, rows: DataFrame, overwrite: bool = False, readers: Mapping[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
        """Import annotation files: each row names set, recording, range, raw file and format. Gives the rejected rows, which are also kept in extra/.

        Raw files are read from annotations/<set>/raw/. Segments are moved by time_seek and cut to their ranges. All files of
        one set and format are read by one plan.
        """
        stamp = datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
        full = rows
        for c, default in (("time_seek", F.lit(0).cast("bigint")), ("imported_at", F.lit(stamp)), ("package_version", F.lit(__version__)), ("merged_from", F.lit(None).cast("string"))):
            full = full if c in full.columns else full.withColumn(c, default)
        full = full.withColumn("annotation_filename", manage.annotation_filename())
        old = self.index().drop("error")
        kept, bad = manage.import_rows(old, full, self.tables()["recordings"], overwrite)
        kept, bad = kept.cache(), bad.cache()
        good = full.join(bad.select(*manage.INDEX_KEY), list(manage.INDEX_KEY), "left_anti")
        found = []
        for r in good.select("set", "format").distinct().collect():
            reader = (readers or {}).get(r["format"]) or formats.READERS[r["format"]]
            these = good.where((F.col("set") == r["set"]) & (F.col("format") == r["format"]))
            paths = [f"{self.root}/annotations/{r['set']}/raw/{x[0]}" for x in these.select("raw_filename").distinct().collect()]
            raw = reader(self.spark, paths)
            joined = raw.join(these.select("set", REC, "annotation_filename", "time_seek", *RANGE, "raw_filename"), "raw_filename")
            moved = manage.shift(joined, F.col("time_seek"))
            found.append(interval.clip(moved, *RANGE).drop("time_seek", *RANGE))
        segments = self.segments()
        stale = segments.join(good.select("set", "annotation_filename").distinct(), ["set", "annotation_filename"], "left_anti")
        for f in found:
            stale = stale.unionByName(f, allowMissingColumns=True)
        self._store(kept, stale)
        if not bad.isEmpty():
            bad.coalesce(1).write.csv(f"{self.root}/extra/errors_{stamp.replace(' ', '_').replace(':', '')}", header=True)
        return bad

    def annotated(self, sets: Sequence[str] | None = None) -> DataFrame:
        """Segments with their index rows, cut to their ranges."""
        some = lambda df: df if sets is None else df.where(F.col("set").isin(*sets))
        return manage.attach(some(self.segments()), some(self.index()))

    def derive(self, input_set: str, output_set: str, derivation: str | Callable[..., DataFrame], **options) -> None:
        mine = self.segments().where(F.col("set") == input_set)
        ranged = mine.join(self.index().where(F.col("set") == input_set).select("annotation_filename", *RANGE), "annotation_filename")
        out, index = derive.derive(ranged, self.index(), input_set, output_set, derivation, **options)
        others = lambda df: df.where(F.col("set") != output_set)
        self._store(others(self.index()).unionByName(index, allowMissingColumns=True), others(self.segments()).unionByName(out.drop(*RANGE), allowMissingColumns=True))

    def merge_sets(self, left: str, right: str, left_columns: Sequence[str], right_columns: Sequence[str], output: str) -> None:
        merged, index = manage.merge(self.segments(), self.index(), left, right, left_columns, right_columns, output)
        index = index.withColumn("annotation_filename", manage.annotation_filename()).withColumn("imported_at", F.lit(datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S")))
        merged = merged.withColumn("annotation_filename", manage.annotation_filename()).drop(*RANGE)
        kinds = dict(self.segments().dtypes)
        merged = merged.withColumns({c: F.when(F.col(c) != "NA", F.col(c)).cast(kinds[c]) for c in (*left_columns, *right_columns) if c in kinds})
        others = lambda df: df.where(F.col("set") != output)
        self._store(others(self.index()).unionByName(index, allowMissingColumns=True), others(self.segments()).unionByName(merged, allowMissingColumns=True))

    def remove_set(self, name: str) -> None:
        self._store(manage.remove_set(self.index(), name), manage.remove_set(self.segments(), name))

    def remove_files(self, rows: DataFrame) -> None:
        """Remove single annotation files: ``rows`` has set and annotation_filename. One file is added by an import of one row."""
        keys = ["set", "annotation_filename"]
        gone = rows.select(*keys).distinct()
        self._store(self.index().join(gone, keys, "left_anti"), self.segments().join(gone, keys, "left_anti"))

    def set_of(self, path: str) -> str:
        """The set that a file below annotations/ belongs to: the folders before raw/ or converted/."""
        inside = path.removeprefix(self.root).strip("/").removeprefix("annotations/").split("/")
        ends = [i for i, x in enumerate(inside) if x in ("raw", "converted", "extra")]
        return "/".join(inside[: ends[0] if ends else -1])

    def subsets(self, name: str) -> list[str]:
        """The sets of the index that lie below a set."""
        return sorted(r["set"] for r in self.index().where(F.col("set").startswith(f"{name}/")).select("set").distinct().collect())

    def _rewrite_recordings(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Metadata are small: one CSV file, written whole."""
        path = "metadata/recordings.csv"
        rows = change(read_table(self.spark, f"{self.root}/{path}")).toPandas()
        self.write_text(path, rows.to_csv(index=False))

    def rename_recording(self, old: str, new: str) -> None:
        """In the metadata, the index and the segments. The new name may not be in use."""
        have = self.tables()["recordings"].select(REC)
        if have.where(F.col(REC) == old).isEmpty() or not have.where(F.col(REC) == new).isEmpty():
            raise ValueError(f"there is no recording {old}, or there is a recording {new}")
        index, segments = manage.rename_recording([self.index(), self.segments()], old, new)
        self._store(index, segments)
        self._rewrite_recordings(lambda df: manage.rename_recording([df], old, new)[0])

    def compute_durations(self, overwrite: bool = False) -> None:
        """duration of each recording in ms from its WAV file below recordings/; a known one stays unless ``overwrite``."""
        found = durations(self.spark, f"{self.root}/recordings/*").select(REC, F.col("duration").cast("string").alias("_found"))

        def change(df: DataFrame) -> DataFrame:
            df = df if "duration" in df.columns else df.withColumn("duration", F.lit(None).cast("string"))
            first, second = ("_found", "duration") if overwrite else ("duration", "_found")
            return df.join(found, REC, "left").withColumn("duration", F.coalesce(first, second)).select(*df.columns)

        self._rewrite_recordings(change)

    def unindexed_files(self) -> DataFrame:
        """Files of recordings/ that no recording names, and recordings without a file: path and problem."""
        files = [(p, "not indexed") for p in self._listed("recordings")]
        on_disk = self.spark.createDataFrame(files, f"{REC} string, problem string")
        named = self.tables()["recordings"].select(REC)
        return on_disk.join(named, REC, "left_anti").unionByName(named.join(on_disk, REC, "left_anti").withColumn("problem", F.lit("missing file")))

    def _listed(self, folder: str) -> list[str]:
        out, path = [], self._path(f"{self.root}/{folder}")
        if self._fs.exists(path):
            it = self._fs.listFiles(path, True)
            base = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getPath().toString().rstrip("/")
            while it.hasNext():
                out.append(it.next().getPath().toString()[len(base) + 1 :])
        return out

    def rename_set(self, old: str, new: str) -> None:
        index = manage.rename_set(self.index(), old, new)
        self._store(index, self.segments().withColumn("set", F.when(F.col("set") == old, new).otherwise(F.col("set"))))

    def set_metadata(self) -> DataFrame:
        """One row for each set that is indexed, from annotations/<set>/metannots.yml, with has_X flags from its columns where the file has none."""
        rows = []
        segments = self.segments()
        # one scan for all sets; the sets come to the driver, as many as folders are read for them
        some = [c for c in segments.columns if c != "set"]
        used = {r["set"]: r for r in segments.groupBy("set").agg(*[F.count(F.when(F.col(f"`{c}`").cast("string") != "NA", 1)).alias(c) for c in some]).collect()}
        for (name,) in self.index().select("set").distinct().collect():
            path = f"annotations/{name}/metannots.yml"
            known = {k: str(v) for k, v in (load_yaml(self.read_text(path)) if self.exists(path) else {}).items()}
            mine = used[name].asDict() if name in used else {}
            rows.append({"set": name, **content_of(["set" for _ in mine][:1] + [c for c in some if mine.get(c)]), **known})
        names = sorted({k for r in rows for k in r} - {"set"})
        return self.spark.createDataFrame([tuple(r.get(k) for k in ("set", *names)) for r in rows], ", ".join(f"`{k}` string" for k in ("set", *names)))

    def validate(self) -> DataFrame:
        """All violations: source, and then column, line, value, problem, severity."""
        root, spark = self.root, self.spark
        chi, rec = (read_table(spark, f"{root}/metadata/{t}.csv", rules, False, True) for t, rules in (("children", CHILDREN), ("recordings", RECORDINGS)))
        out = validate.violations(chi, CHILDREN).withColumn("source", F.lit("children")).unionByName(validate.violations(rec, RECORDINGS).withColumn("source", F.lit("recordings")))
        plain = lambda source, problem, df, column, value, severity="error": df.select(F.lit(column).alias("column"), F.lit(None).cast("bigint").alias("line"), F.col(value).cast("string").alias("value"), F.lit(problem).alias("problem"), F.lit(severity).alias("severity"), F.lit(source).alias("source"))
        data, index = self.tables(), self.index()
        more = [
            plain("children", "duplicate", validate.duplicates(chi, ["child_id"]), "child_id", "child_id"),
            plain("recordings", "duplicate", validate.duplicates(rec, [REC]), REC, REC),
            plain("recordings", "unknown child", validate.orphans(data["recordings"], data["children"], ["child_id"]), "child_id", "child_id"),
            plain("recordings", "recorded before birth", validate.negative_ages(data["recordings"], data["children"]), "date_iso", REC, "warning"),
            plain("children", "several experiments", validate.several_experiments(data["children"]), "experiment", "experiment"),
            plain("index", "invalid range", validate.range_errors(index), "range_onset", "annotation_filename"),
            plain("index", "overlapping range", validate.overlapping_ranges(index), "range_onset", "annotation_filename"),
            plain("index", "unknown recording", validate.orphans(index, data["recordings"], [REC]), REC, REC),
            plain("index", "outdated merge", validate.outdated_merges(index), "merged_from", "set", "warning"),
        ]
        if "duration" in data["recordings"].columns:
            more.append(plain("index", "beyond the recording", validate.duration_overflow(index, data["recordings"]), "range_offset", "annotation_filename"))
        segments = self.segments().withColumn("_line", F.lit(None).cast("bigint"))
        more.append(validate.violations(segments, SEGMENTS).withColumn("source", F.lit("segments")))
        for m in more:
            out = out.unionByName(m)
        return out.select("source", "column", "line", "value", "problem", "severity")

    def explain(self, name: str) -> DataFrame:
        """What is documented about a column, else its declared rule."""
        if self.exists("docs"):
            from earshot.sources.tables import read_documentation

            have = [t for t in ("children", "recordings", "annotations") if self.exists(f"docs/{t}.csv")]
            if have and not (found := read_documentation(self.spark, self.root, have).where(F.col("variable") == name)).isEmpty():
                return found
        rules = [(t, r.name, r.required, r.type.simpleString(), ",".join(r.choices) or r.regex or ",".join(r.formats)) for t, rs in (("children", CHILDREN), ("recordings", RECORDINGS), ("annotations", SEGMENTS), ("index", INDEX)) for r in rs if r.name == name]
        return self.spark.createDataFrame(rules, "table string, variable string, required boolean, type string, values string")
