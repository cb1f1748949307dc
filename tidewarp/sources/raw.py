"""Raw row-major matrices of little-endian numbers as a data source, "rawmatrix"."""
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "id long, series array<double>"
PART_BYTES = 64 << 20  # of records that one task reads, about
BATCH_BYTES = 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


def data_files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a file, or of the data files of a folder in the order of their names."""
    store, at = opened(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def check_files(path: str, width: int, dtype: str) -> None:
    """An error if a file does not consist of whole records."""
    if any(size % (np.dtype(dtype).itemsize * width) for _, size in data_files(path)):
        raise ValueError(f"{path} holds no whole rows of {width} values")


@dataclass
class Records(InputPartition):
    """Records [begin, end) of a file, the first of which has this id."""

    file: str
    begin: int
    end: int
    id: int


class RawMatrix(DataSource):
    """Options: path, width (numbers of a record), dtype (a NumPy name), first and last (ids to read, both
    included), part_bytes. The id of a record is its place in all files; rows are written in the order that they come in."""

    @classmethod
    def name(cls) -> str:
        return "rawmatrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "RecordReader":
        return (FilteredReader if self.options.get("pushdown") == "true" else RecordReader)(self.options)

    def writer(self, schema, overwrite: bool) -> "RecordWriter":
        return RecordWriter(self.options, overwrite)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options["width"])
        self.dtype = np.dtype(options.get("dtype", "f8")).newbyteorder("<")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 2**62))
        self.record = self.dtype.itemsize * self.width

    def partitions(self) -> list[Records]:
        """Ranges of records by bytes, only those that hold wanted ids."""
        check_files(self.path, self.width, self.dtype.str)
        out, at = [], 0
        step = max(1, self.part_bytes // self.record)
        for file, size in data_files(self.path):
            n = size // self.record
            begin, end = max(0, self.first - at), min(n, self.last + 1 - at)
            out += [Records(file, b, min(b + step, end), at + b) for b in range(begin, end, step)]
            at += n
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once even if there are no partitions
            return
        store, _ = opened(self.path)
        step = max(1, BATCH_BYTES // self.record)
        with store.open_input_file(partition.file) as f:
            f.seek(partition.begin * self.record)
            for begin in range(partition.begin, partition.end, step):
                n = min(step, partition.end - begin)
                values = np.frombuffer(f.read(n * self.record), dtype=self.dtype).astype(np.float64)
                ids = np.arange(n, dtype=np.int64) + partition.id + begin - partition.begin
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.width)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(values))], names=["id", "series"])


class FilteredReader(RecordReader):
    """Takes conditions on the id from the plan (spark.sql.python.filterPushdown.enabled). Spark checks them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("id",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, int(value) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, int(value) - isinstance(f, LessThan))
                if isinstance(f, In) and (known := [int(v) for v in value if v is not None]):
                    self.first, self.last = max(self.first, min(known)), min(self.last, max(known))
            yield f


@dataclass
class Part(WriterCommitMessage):
    draft: str
    task: int
    rows: int


class RecordWriter(DataSourceArrowWriter):
    """A part file per task under a name of its own; commit names the parts of the tasks that counted in the order of the
    tasks. So a task that runs twice or fails leaves nothing that is read."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.dtype = np.dtype(options.get("dtype", "f8")).newbyteorder("<").str

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        store, folder = opened(self.path)
        task = TaskContext.get()
        store.create_dir(folder)
        draft, rows = f"{folder}/_draft-{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with store.open_output_stream(draft) as f:
            for batch in iterator:
                f.write(batch.column("series").flatten().to_numpy(zero_copy_only=False).astype(self.dtype).tobytes())
                rows += batch.num_rows
        return Part(draft, task.partitionId(), rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, folder = opened(self.path)
        if self.overwrite:
            for file, _ in data_files(self.path):
                store.delete_file(file)
        after = len(data_files(self.path)) and max(int(posixpath.basename(f)[5:11]) for f, _ in data_files(self.path)) + 1
        for k, part in enumerate(sorted((m for m in messages if m), key=lambda m: m.task)):
            store.move(part.draft, f"{folder}/part-{after + k:06d}.bin")

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = opened(self.path)
        for part in messages:
            if part and store.get_file_info(part.draft).type == fs.FileType.File:
                store.delete_file(part.draft)
