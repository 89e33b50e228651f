"""A Spark data source for match files: tab-separated text under # comments, with the columns that its header names.

Reading is split by file and by ranges of bytes; filters on the file's name decide which files are
opened. Writing makes a folder of parts in order, with the statistics and the header on the first, and
shows nothing until all parts are there.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

NAME = "match_files"
#: Bytes of a file in one partition.
RANGE_BYTES = 64 << 20

# Types of the columns of match files of both widths and of chromatogram tables; all others are text.
LONGS = ("ScanNumber", "ParentCharge", "Rank", "SpectralCount", "ProteinCount")
DOUBLES = ("MeasuredParentMass", "CalculatedParentMass", "MassErrorDa", "MassErrorPPM", "Score", "DeltaZ", "DeltaP", "BestScore", "RetentionTime", "peakHeight")
#: The column of the file's own name.
SOURCE = "source"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path: itself, or those of a folder that end with suffix, in order."""
    fs, at = _opened(path)
    info = fs.get_file_info(at)
    if info.is_file:
        return [(path, info.size)]
    found = [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", "."))]
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found)


def _lines(path: str, start: int, end: int) -> Iterator[str]:
    """Lines of a file that begin in a range of its bytes."""
    fs, at = _opened(path)
    with io.BufferedReader(fs.open_input_file(at)) as f:
        if start:
            f.seek(start - 1)
            f.readline()  # the rest of a line that the range before reads
        while f.tell() < end:
            line = f.readline()
            if not line:
                break
            yield line.decode("utf-8", "replace").rstrip("\r\n")


def _header(path: str, skip: int) -> list[str]:
    """Column names: the first line that is no comment, after `skip` other lines."""
    for line in _lines(path, 0, 1 << 62):
        if line and not line.startswith("#"):
            if skip == 0:
                return [c.strip() for c in line.split("\t")]
            skip -= 1
    return []


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class MatchReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        self.names: set[str] | None = None
        self.skip = int(options.get("skip", 0))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the file's name pick the files; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (SOURCE,):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        step = int(self.options.get("rangebytes", RANGE_BYTES))
        files = _files(self.options["path"], self.options.get("suffix", ""))
        chosen = [(p, n) for p, n in files if self.names is None or p.rsplit("/", 1)[-1] in self.names]
        return [_Range(p, a, min(a + step, n)) for p, n in chosen for a in range(0, n, step)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.path:
            return
        header = _header(partition.path, self.skip)
        at = {c: i for i, c in enumerate(header)}
        cast = {DoubleType(): float, LongType(): int}
        fields = [(at.get(f.name), cast.get(f.dataType)) for f in self.schema.fields if f.name != SOURCE]
        source = partition.path.rsplit("/", 1)[-1]
        title = "\t".join(header)
        above = self.skip if partition.start == 0 else 0
        for line in _lines(partition.path, partition.start, partition.end):
            if not line or line.startswith("#"):
                continue
            if above:
                above -= 1
                continue
            if "\t".join(c.strip() for c in line.split("\t")) == title:
                continue
            values = line.split("\t")
            yield (*(_value(values, i, as_type) for i, as_type in fields), source)


def _value(values: list[str], i: int | None, as_type: type | None):  # noqa: ANN202
    """A field's value; null where the line has none, it is empty, or no number."""
    if i is None or i >= len(values) or values[i].strip() == "":
        return None
    if as_type is None:
        return values[i].strip()
    try:
        return as_type(values[i])
    except ValueError:
        return None


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str


class ReportWriter(DataSourceWriter):
    """Every attempt writes a file of its own under _temporary; commit names those that Spark chose, abort leaves nothing."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns, self.options = schema.names, options
        self.job = uuid.uuid4().hex

    def _path(self) -> tuple[pafs.FileSystem, str]:
        fs, at = _opened(self.options["path"])
        return fs, at.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> _Part:
        context = TaskContext.get()
        number = context.partitionId() if context is not None else int(self.options.get("partition", 0))
        fs, at = self._path()
        folder = f"{at}/_temporary/{self.job}"
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/{number:05d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as f:
            if number == 0:
                for line in self.options.get("head", "").split("\n") if self.options.get("head") else []:
                    f.write(f"#\t{line}\n".encode())
                f.write(("\t".join(self.columns) + "\n").encode())
            for row in iterator:
                f.write(("\t".join("" if v is None else str(v).replace("\t", " ").replace("\n", " ") for v in row) + "\n").encode())
        return _Part(number, path)

    def commit(self, messages: list[_Part | None]) -> None:
        fs, at = self._path()
        for part in messages:
            if part is not None:
                fs.move(part.path, f"{at}/part-{part.partition:05d}.txt")
        fs.delete_dir(f"{at}/_temporary")
        with fs.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Part | None]) -> None:
        fs, at = self._path()
        if fs.get_file_info(f"{at}/_temporary").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/_temporary")


class MatchFiles(DataSource):
    """Format match_files; options: path (a file or folder, local or a URI that Arrow opens), suffix, skip (lines before the header), rangeBytes; head to write."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        files = _files(self.options["path"], self.options.get("suffix", ""))
        columns: dict[str, None] = {}
        for path, _ in files:  # the first lines of each file
            columns |= dict.fromkeys(_header(path, int(self.options.get("skip", 0))))
        kind = lambda c: LongType() if c in LONGS else DoubleType() if c in DOUBLES else StringType()
        return StructType([StructField(c, kind(c)) for c in columns] + [StructField(SOURCE, StringType())])

    def reader(self, schema: StructType) -> MatchReader:
        return MatchReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        fs, at = _opened(self.options["path"])
        there = [f for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if not f.base_name.startswith("_temporary")]
        if there and not overwrite:
            raise FileExistsError(f"{self.options['path']} is not empty")
        for f in there:
            (fs.delete_dir if f.type == pafs.FileType.Directory else fs.delete_file)(f.path)
        return ReportWriter(schema, dict(self.options))


def read_matches(spark: SparkSession, path: str, suffix: str = "", skip: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of match files of any widths, with the columns of all headers (null where a file lacks one) and the file's name as source.

    Comments, empty lines and headers are left out; short lines are filled with nulls; what is
    no number in a number's column is null. skip: other lines before the header (1 for
    chromatogram tables). A filter on source reads only the files that it names.
    """
    spark.dataSource.register(MatchFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("suffix", suffix).option("skip", skip).option("rangeBytes", range_bytes).load(path)


def write_report(rows: DataFrame, path: str, order: Sequence[Column | str], head: Sequence[str] = (), parts: int = 8, mode: str = "append") -> None:
    """rows as one report in parts: in order over all parts, with head as # comments and the column names on the first.

    Parts are ranges of the order, each sorted by itself. The folder shows them, and _SUCCESS, once
    all are written; attempts that failed or came second leave nothing. mode append refuses a folder that holds files, overwrite empties it.
    """
    rows.sparkSession.dataSource.register(MatchFiles)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.write.format(NAME).option("head", "\n".join(head)).mode(mode).save(path)


def statistics(rows: DataFrame, is_target: Column) -> list[str]:
    """Lines of a report's head: targets, decoys and their ratio."""
    counts = rows.agg(F.count(F.when(is_target, 1)).alias("t"), F.count(F.when(~is_target, 1)).alias("d")).first()  # one row
    rate = counts["d"] / counts["t"] if counts["t"] else 0.0
    return ["[Statistical_Results]", f"Targets = {counts['t']}", f"Decoys = {counts['d']}", f"FDR = {rate:.6f}"]
