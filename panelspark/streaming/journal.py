"""A growing JSON-lines journal as a stream: a data source that remembers byte offsets of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .runs import EVENT

LINE = "file string, offset long, value string"


class Span(InputPartition):
    """Lines of a file that begin in [start, stop); begin: whether a line begins at start."""

    def __init__(self, file: str, start: int, stop: int, begin: bool) -> None:
        self.file, self.start, self.stop, self.begin = file, start, stop, begin


class JournalReader(DataSourceStreamReader):
    """Offsets are a dictionary of files and the bytes read of each. Only whole lines count, so half a last line waits for
    its end; a file that is shorter than what was read of it has begun anew and is read from its start."""

    def __init__(self, path: str, span: int) -> None:
        self.path, self.span = path, span

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if ":" in self.path else (pafs.LocalFileSystem(), self.path)

    def _whole(self, fs: pafs.FileSystem, file: str, size: int) -> int:
        """Bytes up to the last line end."""
        with fs.open_input_file(file) as f:
            stop = size
            while stop > 0:
                start = max(0, stop - (1 << 16))
                f.seek(start)
                at = f.read(stop - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                stop = start
        return 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, folder = self._folder()
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        files = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        return {f.base_name: self._whole(fs, f.path, f.size) for f in sorted(files, key=lambda f: f.base_name)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for file, stop in end.items():
            first = start.get(file, 0) if start.get(file, 0) <= stop else 0
            out += [Span(file, k, min(k + self.span, stop), k == first) for k in range(first, stop, self.span)]
        return out

    def read(self, partition: Span) -> Iterator[tuple[str, int, str]]:
        fs, folder = self._folder()
        with fs.open_input_file(f"{folder}/{partition.file}") as f:
            at = partition.start if partition.begin else partition.start - 1
            f.seek(at)
            rest, skip = b"", not partition.begin  # the line that begins before the span is another's
            while at < partition.stop or rest:
                chunk = f.read(1 << 20)
                if not chunk:
                    return
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    if not skip:
                        if at >= partition.stop:
                            return
                        yield partition.file, at, line.decode("utf-8", "replace")
                    at, skip = at + len(line) + 1, False
                if at >= partition.stop:
                    return

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


class JournalSource(DataSource):
    """spark.readStream.format("journal").option("path", folder): rows of LINE; option span: bytes that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema: object) -> JournalReader:  # noqa: N802
        return JournalReader(self.options["path"], int(self.options.get("span", 64 << 20)))


def follow(spark: SparkSession, folder: str, schema: str = EVENT, span: int = 64 << 20) -> DataFrame:
    """A stream of the lines that are appended to the folder's files: file, offset (of the line's first byte), raw, event (null
    if malformed), malformed. Blank lines are left out. A file that was cut and has grown past what was read of it before the
    next look can't be told from one that has only grown."""
    spark.dataSource.register(JournalSource)
    fields = spark.createDataFrame([], schema).schema
    lines = spark.readStream.format("journal").option("path", folder).option("span", span).load().where("trim(value) <> ''")
    e = F.from_json("value", fields, {"mode": "PERMISSIVE"})
    known = F.coalesce(F.to_json(e) != "{}", F.lit(False))
    return lines.select("file", "offset", F.col("value").alias("raw"), F.when(known, e).alias("event"), (~known).alias("malformed"))
