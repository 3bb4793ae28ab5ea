"""Lines of growing transcript files as a data source, read once in a stream or all in a batch, and their capture.

The cursor is a byte behind a line feed for each file, with a digest of its first line. A stream's offsets hold it, so
the checkpoint does: a restart goes on where the last batch ended. What follows the last line feed may still be written
and is held back. A file that is shorter than its cursor or begins with another line was truncated or replaced and is
read from its start. Large files are dealt to several tasks by ranges of bytes; the driver only looks at both ends.
"""

from __future__ import annotations

import hashlib
import io
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..sources import episodes as E

SCHEMA = "path string, start long, offset long, value string"
#: Bytes of a range for one task, of a step back from a file's end, and of a batch of lines.
RANGE, STEP, BATCH = 64 << 20, 1 << 16, 4 << 20


class Range(InputPartition):
    """The lines that begin at a byte from `low` on and before `high`; start: where this capture of the file begins."""

    def __init__(self, path: str, start: int, low: int, high: int):
        self.path, self.start, self.low, self.high = path, start, low, high


def _opened(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _ends(store, path: str, size: int) -> tuple[int, str] | None:
    """The byte behind the last line feed and the first line's digest; None if no line is complete."""
    with store.open_input_file(path) as f:
        head = f.read(min(size, STEP)).split(b"\n")
        at = size
        while at > 0:
            f.seek(max(0, at - STEP))
            block = f.read(at - max(0, at - STEP))
            if (k := block.rfind(b"\n")) >= 0:
                return max(0, at - STEP) + k + 1, hashlib.sha256(head[0]).hexdigest()[:16]
            at -= STEP
    return None


def snapshot(options: dict, known: dict | None = None) -> dict:
    """path -> [cursor, digest] of every transcript below the option path. known: (size, time) and result of the last look."""
    from pyarrow import fs

    store, top = _opened(options["path"])
    suffix, found = options.get("suffix", ".jsonl"), {}
    for info in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
        if info.type != fs.FileType.File or not info.path.endswith(suffix):
            continue
        seen = (info.size, info.mtime_ns)
        if known is None or known.get(info.path, (None,))[0] != seen:
            ends = _ends(store, info.path, info.size)
            if known is not None:
                known[info.path] = (seen, ends)
        else:
            ends = known[info.path][1]
        if ends:
            found[info.path] = list(ends)
    return found


def ranges(start: dict, end: dict, size: int = RANGE) -> list[Range]:
    """What lies between two snapshots."""
    out = []
    for path, (to, digest) in sorted(end.items()):
        begin, was = start.get(path, (0, digest))
        begin = 0 if was != digest or to < begin else begin
        out += [Range(path, begin, low, min(low + size, to)) for low in range(begin, to, size)]
    return out


class _Reader:
    def __init__(self, options: dict):
        self.options = dict(options)

    def read(self, partition: Range):
        store, _ = _opened(self.options["path"])
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        with io.BufferedReader(store.open_input_file(partition.path), STEP) as f:
            at = partition.low
            if at > 0:  # a line that began before belongs to the range before
                f.seek(at - 1)
                at = at - 1 + len(f.readline())
            rows, held = [], 0
            while at < partition.high and (line := f.readline()).endswith(b"\n"):
                rows.append((partition.path, partition.start, at, line[:-1].decode("utf-8", "replace")))
                at, held = at + len(line), held + len(line)
                if held > BATCH:
                    yield _rows(rows, names, kinds)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, names, kinds)


def _rows(rows, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class _Batch(_Reader, DataSourceReader):
    def partitions(self):
        return ranges({}, snapshot(self.options), int(self.options.get("range", RANGE))) or [Range("", 0, 0, 0)]

    def read(self, partition):
        return super().read(partition) if partition.path else iter(())


class _Stream(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.known: dict = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": snapshot(self.options, self.known)}

    def partitions(self, start: dict, end: dict):
        return ranges(start["files"], end["files"], int(self.options.get("range", RANGE)))

    def commit(self, end: dict) -> None:
        """Offsets hold all there is to keep."""


class TranscriptLines(DataSource):
    """Options: path, a folder that all machines reach; suffix (.jsonl); range, in bytes."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def lines(spark: SparkSession, root: str, **options) -> DataFrame:
    """All complete lines below root: path, start (0), offset of the line's first byte, and value."""
    spark.dataSource.register(TranscriptLines)
    return spark.read.format("transcript_lines").options(path=root, **options).load()


def stream(spark: SparkSession, root: str, **options) -> DataFrame:
    """The same as a stream; start is where a batch's part of the file begins."""
    spark.dataSource.register(TranscriptLines)
    return spark.readStream.format("transcript_lines").options(path=root, **options).load()


def capture(spark: SparkSession, root: str, out: str, checkpoint: str, **options) -> None:
    """Writes an episode for what each transcript has gained since the last call, below out, a folder for each batch.

    A batch that is run again after a failure writes its folder again, so no segment comes twice."""

    def write(batch: DataFrame, number: int) -> None:
        found = E.capturable(E.episodes(batch))
        found.select("segment_id", "session_id", "path", "start", E.render(found, "segment_id").alias("content")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream(spark, root, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
