"""A topic kept as files, consumed as a stream by offsets.

The folder is the one ``sinks.prefill`` fills: Parquet under ``partition=<n>``, each message with its ``offset`` there.
A stream's state is the next offset of every partition; it lies in Spark's own checkpoint, so a stopped or failed query goes
on where its last committed batch ended. Each partition is read by a task of its own, which is handed only the files
whose footers say that they hold offsets it was planned for, and passes Arrow batches on.

With a limit, a trigger takes that many messages at most, shared by the partitions as their backlogs are. A reader is
not told where a restarted query stands, so the ends it planned are kept in the group's folder too: they pace it, and
tell others how far the group is, but decide nothing.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "key string, value binary, topic string, partition int, offset bigint"
BATCH_ROWS = 1024  # messages passed on at once

# workers get this module's classes by value: they need not find the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class Slice(InputPartition):
    """Offsets ``[start, end)`` of a partition, and the files that hold them."""

    def __init__(self, partition: int, start: int, end: int, files: list[str]):
        self.partition, self.start, self.end, self.files = partition, start, end, files


class TopicReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.group = options["path"], options.get("group")
        self.limit = int(options.get("pertrigger", 0))
        self.from_latest = options.get("startingoffsets", "earliest") == "latest"
        if self.limit and not self.group:
            raise ValueError("a limit a trigger needs the folder of a group")
        self._spans: dict[str, tuple[int, int]] = {}  # files never change
        self._reached: dict[str, int] | None = None

    # --- what the topic holds ---

    def _files(self) -> dict[int, list[tuple[int, int, str]]]:
        """Per partition (first, next offset, file) by first offset, from footers alone."""
        fs, root = _filesystem(self.path)
        found: dict[int, list[tuple[int, int, str]]] = {}
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            place = re.search(r"/partition=(\d+)/[^/_.][^/]*\.parquet$", info.path)
            if not place or not info.is_file:
                continue
            if info.path not in self._spans:
                self._spans[info.path] = self._span(fs, info.path)
            first, end = self._spans[info.path]
            if first < end:
                found.setdefault(int(place[1]), []).append((first, end, info.path))
        return {p: sorted(spans) for p, spans in found.items()}

    @staticmethod
    def _span(fs: pafs.FileSystem, path: str) -> tuple[int, int]:
        with fs.open_input_file(path) as file:
            parquet = pq.ParquetFile(file)
            column = parquet.schema_arrow.names.index("offset")
            groups = [parquet.metadata.row_group(i).column(column).statistics for i in range(parquet.num_row_groups)]
            if all(g is not None and g.has_min_max for g in groups):
                bounds = [(g.min, g.max) for g in groups]
            else:
                offsets = parquet.read(columns=["offset"])["offset"].to_pylist()
                bounds = [(min(offsets), max(offsets))] if offsets else []
        return min((a for a, _ in bounds), default=0), max((z for _, z in bounds), default=-1) + 1

    def _ends(self) -> dict[str, int]:
        return {str(p): max(end for _, end, _ in spans) for p, spans in sorted(self._files().items())}

    # --- where the group is ---

    def _kept(self) -> dict[str, int] | None:
        fs, root = _filesystem(self.group)
        infos = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        names = sorted(i.path for i in infos if re.search(r"/\d{20}\.json$", i.path))
        if not names:
            return None
        with fs.open_input_stream(names[-1]) as file:
            return json.loads(file.read())

    def _keep(self, ends: dict[str, int]) -> None:
        fs, root = _filesystem(self.group)
        fs.create_dir(root)
        name = f"{root}/{sum(ends.values()):020d}.json"
        with fs.open_output_stream(f"{name}.tmp") as file:
            file.write(json.dumps(ends).encode())
        fs.move(f"{name}.tmp", name)

    # --- the stream ---

    def initialOffset(self) -> dict:
        return self._ends() if self.from_latest else {}

    def latestOffset(self) -> dict:
        ends = self._ends()
        if not self.limit:
            return ends
        if self._reached is None:
            kept = self._kept()
            self._reached = self.initialOffset() if kept is None else kept
        backlog = {p: end - self._reached.get(p, 0) for p, end in ends.items()}
        share = min(1.0, self.limit / max(1, sum(backlog.values())))
        # at least one message of each partition that has any, so that none waits for ever
        return {p: self._reached.get(p, 0) + min(n, max(1, int(n * share))) if n > 0 else end for (p, n), end in zip(backlog.items(), ends.values(), strict=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.group:
            self._keep(end)
        self._reached = dict(end)
        slices = []
        for partition, spans in self._files().items():
            a, z = start.get(str(partition), 0), end.get(str(partition), 0)
            if a < z:
                slices.append(Slice(partition, a, z, [f for first, last, f in spans if first < z and last > a]))
        return slices

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        offset = ds.field("offset")
        inside = (offset >= partition.start) & (offset < partition.end)
        wanted = {"key": pa.string(), "value": pa.binary(), "topic": pa.string(), "offset": pa.int64()}
        for file in partition.files:
            rows = ds.dataset(file, filesystem=fs, format="parquet")
            for batch in rows.scanner(columns=list(wanted), filter=inside, batch_size=BATCH_ROWS).to_batches():
                columns = {n: batch.column(n).cast(t) for n, t in wanted.items()}
                number = pa.array([partition.partition] * len(batch), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [columns["key"], columns["value"], columns["topic"], number, columns["offset"]],
                    ["key", "value", "topic", "partition", "offset"],
                )

    def commit(self, end: dict) -> None:
        """Ends before these pace nothing any more."""
        if not self.group:
            return
        fs, root = _filesystem(self.group)
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            name = re.search(r"/(\d{20})\.json$", info.path)
            if name and int(name[1]) < sum(end.values()):
                fs.delete_file(info.path)


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TopicReader({k.lower(): v for k, v in self.options.items()})


def consume(
    spark: SparkSession, path: str, group: str | None = None, per_trigger: int | None = None, *, latest: bool = False
) -> DataFrame:
    """The topic's messages as a stream, from its beginning, or with ``latest`` from its end.

    Offsets without a message are passed over. ``group`` is a folder in shared storage, needed with a limit a trigger.
    """
    spark.dataSource.register(TopicSource)
    reader = spark.readStream.format("topic_folder").option("path", path)
    reader = reader.option("startingOffsets", "latest" if latest else "earliest")
    if group:
        reader = reader.option("group", group)
    if per_trigger:
        reader = reader.option("perTrigger", str(per_trigger))
    return reader.load()
