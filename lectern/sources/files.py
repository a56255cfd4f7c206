"""Rows (name, content) as files of a folder, with a commit: readers see all files of a job or none.

Each task writes below a folder of its own attempt: the files, and a list of their names. It reports how many there are, so the
commit puts down one manifest that names the attempts, a line for each task, and removes what attempts left that failed or lost
a race; an abort removes the job's folder. Readers take the names from the lists, in tasks, and deal the files out by number
and bytes; no folder is listed, and the driver holds no name. A repeated name is an error at the commit. Files are written
through Arrow's file systems, so a path or a URI of a store that Arrow knows may be named.
"""

from __future__ import annotations

import io
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from lectern.sources.shared import opened

MANIFEST = "manifest-{}.json"
#: An attempt's files, and the list of their names, a JSON string a line.
FILES, NAMES = "files", "names.json"
#: Bytes of files that leave a task in one batch.
HELD = 16 << 20
#: Bytes of files, and their number, that one task reads; names that a reader of lists holds at once.
TASK_BYTES, TASK_FILES, LISTED = 32 << 20, 2000, 4096


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    n: int
    size: int


class FileSetWriter(DataSourceWriter):
    """later: the commit leaves the manifest to publish(), for who compares the names in tasks (see write_files)."""

    def __init__(self, path: str, job: str | None = None, later: bool = False):
        self.path, self.job, self.later = path, job or uuid.uuid4().hex, later

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, at = opened(self.path)
        attempt, n, size = uuid.uuid4().hex, 0, 0
        folder = f"{at}/{self.job}/{attempt}"
        fs.create_dir(f"{folder}/{FILES}", recursive=True)
        with fs.open_output_stream(f"{folder}/{NAMES}", buffer_size=1 << 16) as listed:
            for row in iterator:
                if not row.name or "/" in row.name or row.name.startswith(("_", ".")):
                    raise ValueError(f"no name of a file: {row.name!r}")
                content = bytes(row.content or b"")
                with fs.open_output_stream(f"{folder}/{FILES}/{row.name}") as out:
                    out.write(content)
                listed.write(json.dumps(row.name).encode() + b"\n")
                n, size = n + 1, size + len(content)
        return Written(attempt, n, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        done = {m.attempt: m for m in messages if m}
        for info in fs.get_file_info(pafs.FileSelector(f"{at}/{self.job}", allow_not_found=True)):
            if info.base_name not in done:
                fs.delete_dir(info.path)
        with fs.open_output_stream(f"{at}/{MANIFEST.format(self.job)}.new") as out:
            out.write(json.dumps({"job": self.job, "attempts": [{"folder": f"{self.job}/{a}", "n": m.n, "size": m.size} for a, m in done.items() if m.n]}).encode())
        if not self.later:
            self.refuse(*self._twice(done))
            self.publish()

    def _twice(self, done: dict[str, Written]) -> tuple[int, str | None]:
        """How many names come more than once, and the least: by a pass over the lists for each share of the names."""
        fs, at = opened(self.path)
        shares, n, least = max(1, math.ceil(sum(m.n for m in done.values()) / 100_000)), 0, None
        for share in range(shares):
            seen, again = set(), set()
            for a in done:
                for names in _listed(fs, f"{at}/{self.job}/{a}"):
                    for name in names:
                        if zlib.crc32(name.encode()) % shares == share:
                            (again if name in seen else seen).add(name)
            n, least = n + len(again), min([*again, *([least] if least is not None else [])], default=None)
        return n, least

    def refuse(self, n: int, least: str | None) -> None:
        """An error, and the job's files go, if there are names that come more than once."""
        if n:
            fs, at = opened(self.path)
            fs.delete_dir(f"{at}/{self.job}")
            fs.delete_file(f"{at}/{MANIFEST.format(self.job)}.new")
            raise ValueError(f"{n} names come more than once, such as {least!r}")

    def publish(self) -> None:
        fs, at = opened(self.path)
        fs.move(f"{at}/{MANIFEST.format(self.job)}.new", f"{at}/{MANIFEST.format(self.job)}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        if fs.get_file_info(f"{at}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/{self.job}")


class FileSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileSetWriter:
        if overwrite:
            raise ValueError("a file set is appended to")
        return FileSetWriter(self.options["path"], self.options.get("job"), self.options.get("later") == "true")


def write_files(rows: DataFrame, path: str) -> None:
    """All rows as one job's files. Names are compared in tasks, before the manifest is there."""
    spark, writer = rows.sparkSession, FileSetWriter(path, later=True)
    spark.dataSource.register(FileSet)
    rows.select("name", "content").write.format("file_set").option("job", writer.job).option("later", "true").mode("append").save(path)
    again = _names(spark, path, f"{MANIFEST.format(writer.job)}.new").groupBy("name").count().where("count > 1")
    writer.refuse(*again.agg(F.count("*"), F.min("name")).first())
    writer.publish()


def _listed(fs: pafs.FileSystem, folder: str) -> Iterator[list[str]]:
    """Names of an attempt's files, at most LISTED at once."""
    with fs.open_input_stream(f"{folder}/{NAMES}") as f:
        held = []
        for line in io.BufferedReader(f, 1 << 16):
            held.append(json.loads(line))
            if len(held) == LISTED:
                yield held
                held = []
        if held:
            yield held


def _attempts(spark: SparkSession, path: str, manifests: str) -> DataFrame:
    """folder, n, size: committed attempts of tasks."""
    found = spark.read.schema("job string, attempts array<struct<folder: string, n: bigint, size: bigint>>").json(f"{path}/{manifests}")
    return found.select(F.explode("attempts").alias("a")).select("a.*")


def _names(spark: SparkSession, path: str, manifests: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                for names in _listed(fs, f"{at}/{folder}"):
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{FILES}/{x}" for x in names], pa.string()), pa.array(names, pa.string())], names=["path", "name"])

    n = spark.sparkContext.defaultParallelism
    return _attempts(spark, path, manifests).select("folder").repartition(n).mapInArrow(run, "path string, name string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path (below the folder), name: committed files, of all jobs. Attempts that aren't committed are not named."""
    return _names(spark, path, MANIFEST.format("*"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the committed files, dealt out to tasks by their number and bytes, to every core at least."""
    n, size = _attempts(spark, path, MANIFEST.format("*")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "name string, content binary")
    tasks = max(min(n, spark.sparkContext.defaultParallelism), math.ceil(size / TASK_BYTES), math.ceil(n / TASK_FILES))
    return contents(manifest(spark, path).repartition(tasks), path).select("name", "content")


def contents(rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    """rows plus content: the bytes of the file that each row's path names, below root. Only these files are opened, each by
    the task that has its row; what leaves it at once is at most HELD bytes, or one file. A missing file is null."""
    schema = StructType([*[f for f in rows.schema.fields if f.name != "content"], StructField("content", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(root)
        for batch in batches:
            begin, held, size = 0, [], 0
            for i, name in enumerate(batch.column(path).to_pylist()):
                held.append(_bytes(fs, f"{at}/{name}") if name else None)
                size += len(held[-1] or b"")
                if size > HELD or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], names=schema.names)
                    begin, held, size = i + 1, [], 0

    return rows.select(*schema.names[:-1]).mapInArrow(run, schema)


def _bytes(fs: pafs.FileSystem, at: str) -> bytes | None:
    try:
        with fs.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None
