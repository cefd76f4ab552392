"""Decisions brought to the documents: lists keyed by a row's place in its file, read by the task that scans it, so that no text is shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.storage import cut, shared_folder

#: log2 of the rows of a file whose lists lie together.
BLOCK = 16
PLACE = ("place_file", "place_row")
_PASSING = {"Project", "Filter", "SubqueryAlias"}


def _scans_one_parquet_table(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is a row of a Parquet file, and no row comes twice."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in _PASSING:
        node = node.children().head()
    return node.nodeName().startswith(("LogicalRelation", "Relation")) and node.children().isEmpty()


class Placed:
    """``docs`` with the place of each row: a 64-bit hash of its file's path and its number in it.

    A table that isn't read straight from Parquet files has no places; it is written to the shared folder once and read
    from there. ``df`` has all columns, renamed by position (c0, c1, ...), so that no name can clash, and then PLACE.
    """

    def __init__(self, docs: DataFrame):
        self.columns, self.schema, self.spark = docs.columns, docs.schema, docs.sparkSession
        df = None
        numbered = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
        place = [F.xxhash64("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1])]
        if "_metadata" not in {c.lower() for c in docs.columns} and _scans_one_parquet_table(docs):
            try:
                df = docs.select(*numbered, *place)
            except AnalysisException:  # another format than Parquet
                df = None
        self.df = cut(docs.select(*numbered)).select("*", *place) if df is None else df

    def col(self, name: str) -> Column:
        """A column of the documents by the name that it has there."""
        return F.col(f"c{[c.lower() for c in self.columns].index(name.lower())}")

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(PLACE[0], F.shiftright(PLACE[1], BLOCK)), F.lit(parts)).cast("int")

    def apply(self, lists: DataFrame, parts: int, change: Callable[[pa.RecordBatch, np.ndarray, pa.Array | None], pa.RecordBatch], schema: T.StructType) -> DataFrame:
        """``change`` of each batch of the documents, with the numbers of those of its rows that ``lists`` has, and what it has for them.

        ``lists`` has PLACE, a row for each place at most, and one further column or none. It is written to the shared folder
        in ``parts``, each with the lists of some blocks of rows of a file, and a task reads those of the rows it scans: what
        is moved grows with the lists and not with the documents, and nothing is collected or broadcast.
        """
        folder = f"{shared_folder(self.spark)}/lists-{uuid.uuid4().hex}"
        parts = max(1, int(parts))
        keyed = lists.withColumn("part", self._part(parts))
        keyed.repartition(parts, "part").sortWithinPartitions("part", *PLACE).write.partitionBy("part").parquet(folder)
        source = self.df.withColumn("place_part", self._part(parts))
        width, names = len(self.columns), schema.names

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = _Lists(folder)
            for batch in batches:
                at, found = have.find(*(np.asarray(batch.column(width + i)) for i in range(3)))
                yield pa.RecordBatch.from_arrays(change(pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width]), at, found).columns, names=names)

        return source.mapInArrow(task, schema)


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith(("s3a://", "s3n://")) else uri)


class _Lists:
    """The lists of one folder, as a task needs them: the part that it reads last is kept."""

    def __init__(self, uri: str):
        self.fs, self.path = _file_system(uri)
        self.part, self.table = -1, None

    def _load(self, part: int) -> None:
        path = f"{self.path}/part={part}"
        self.part, self.table = part, None
        if self.fs.get_file_info(path).type == pa.fs.FileType.Directory:
            names = [f.path for f in self.fs.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".parquet")]
            if names:
                table = pa.concat_tables(pq.read_table(n, filesystem=self.fs, use_threads=False, partitioning=None) for n in sorted(names)).combine_chunks()
                self.file, self.row = (table.column(c).to_numpy() for c in PLACE)
                rest = [c for c in table.column_names if c not in (*PLACE, "part")]
                order = np.lexsort((self.row, self.file))
                self.file, self.row = self.file[order], self.row[order]
                value = table.column(rest[0]).combine_chunks() if rest else None
                self.value = value.take(pa.array(order)) if value is not None else None
                self.table = table

    def find(self, file: np.ndarray, row: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, pa.Array | None]:
        if not len(row):
            return np.zeros(0, np.int64), None
        ats, values = [], []
        cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), len(row)]
        for a, b in zip(cuts, cuts[1:]):
            if part[a] != self.part:
                self._load(int(part[a]))
            if self.table is None:
                continue
            low, high = np.searchsorted(self.file, file[a], "left"), np.searchsorted(self.file, file[a], "right")
            rows = self.row[low:high]
            if not len(rows):
                continue
            i = np.searchsorted(rows, row[a:b])
            hit = np.flatnonzero(rows[np.minimum(i, len(rows) - 1)] == row[a:b])
            if len(hit):
                ats.append(hit + a)
                if self.value is not None:
                    values.append(self.value.take(pa.array(i[hit] + low)))
        at = np.concatenate(ats) if ats else np.zeros(0, np.int64)
        return at, pa.concat_arrays(values) if values else None
