"""A data source for the layout of one JSON file per record, ``{root}/{language}/{id}.json``.

Spark's file scan charges every file as if it had some megabytes and lists all
of them.  Here the listing is planned for many small files: language and id
filters go into it (a list of ids opens only its files, a language only its
folder), and files are packed into partitions by their sizes, so ten thousand
small records are tens of tasks.  A task reads its files one after another and hands
them on in Arrow batches; parsing stays with Spark's JSON functions.

Paths are resolved by ``pyarrow.fs`` (local, HDFS, S3, GCS); stores that only
Spark reaches are read by Spark's own text source (``readers``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "language string, id string, path string, value string"
PARTITION_BYTES = 32 << 20
OPEN_BYTES = 16 << 10  # what opening a file counts for
BATCH_BYTES = 8 << 20
SUFFIX = ".json"
HIDDEN = ("_", ".")


@dataclass
class Packed(InputPartition):
    """Files of one task: (language, id, path)."""

    files: list[tuple[str, str, str]]


def pack(sized: Iterable[tuple[tuple[str, str, str], int]], most: int = PARTITION_BYTES, opening: int = OPEN_BYTES) -> list[Packed]:
    """Files in listing order, cut where a partition is full; a larger file is alone."""
    parts, held, bytes_ = [], [], 0
    for file, size in sized:
        if held and bytes_ + size + opening > most:
            parts.append(Packed(held))
            held, bytes_ = [], 0
        held.append(file)
        bytes_ += size + opening
    return [*parts, Packed(held)] if held else parts


class RecordFiles(DataSource):
    """``spark.read.format("record_files").option("path", root)``; ``languages`` and ``ids`` are lists joined by line feeds."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown") == "true" else RecordReader)(options)


def _list(options: dict, name: str) -> list[str] | None:
    return options[name].split("\n") if name in options else None


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.root = low["path"]
        self.languages, self.ids = _list(low, "languages"), _list(low, "ids")
        self.most = int(low.get("partitionbytes", PARTITION_BYTES))

    def _files(self) -> Iterator[tuple[tuple[str, str, str], int]]:
        store, root = pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)
        root = root.rstrip("/")
        languages = self.languages
        if languages is None:
            found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
            languages = [f.base_name for f in found if f.type == pafs.FileType.Directory and not f.base_name.startswith(HIDDEN)]
        for language in sorted(set(languages)):
            if self.ids is not None:  # no listing at all
                ids = sorted(set(self.ids))
                infos = store.get_file_info([f"{root}/{language}/{i}{SUFFIX}" for i in ids]) if ids else []
            else:
                infos = store.get_file_info(pafs.FileSelector(f"{root}/{language}", allow_not_found=True))
            for f in sorted(infos, key=lambda f: f.path):
                if f.type == pafs.FileType.File and f.base_name.endswith(SUFFIX) and not f.base_name.startswith(HIDDEN):
                    yield (language, f.base_name[:-len(SUFFIX)], f.path), f.size or 0

    def partitions(self) -> Sequence[InputPartition]:
        return pack(self._files(), self.most) or [Packed([])]

    def read(self, partition: Packed) -> Iterator[pa.RecordBatch]:
        store = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else pafs.LocalFileSystem()
        names = ["language", "id", "path", "value"]
        rows: list[tuple] = []
        held = 0
        for language, id_, path in partition.files:
            with store.open_input_stream(path) as f:
                body = f.read()
            rows.append((language, id_, path, body.decode("utf-8", "replace")))
            held += len(body)
            if held > BATCH_BYTES:
                yield _batch(rows, names)
                rows, held = [], 0
        if rows:
            yield _batch(rows, names)


class PushingReader(RecordReader):
    """For sessions that push filters into Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and lists of values of language and id narrow the listing; the others are Spark's."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("language",), ("id",)):
                yield f
                continue
            name = "languages" if f.attribute == ("language",) else "ids"
            known = getattr(self, name)
            values = [v for v in values if v is not None]
            setattr(self, name, values if known is None else [v for v in known if v in set(values)])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)


def reachable(root: str) -> bool:
    """Whether ``pyarrow.fs`` knows the path's store."""
    if "://" not in root and not root.startswith("file:"):
        return True
    try:
        pafs.FileSystem.from_uri(root)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def record_files(spark: SparkSession, root: str, languages: Sequence[str] | None = None, ids: Sequence[str] | None = None,
                 partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(language, id, path, value) of the files, whole."""
    spark.dataSource.register(RecordFiles)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    r = spark.read.format("record_files").option("partitionBytes", partition_bytes).option("pushdown", pushes)
    if languages is not None:
        r = r.option("languages", "\n".join(languages))
    if ids is not None:
        r = r.option("ids", "\n".join(ids))
    return r.option("path", root).load()
