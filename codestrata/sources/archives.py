"""Zip archives as a data source: ``spark.read.format("repository_archive").load(folder or archive)`` after ``register(spark)``.

Gives (repo, path, content, bytes, symlink), a row an entry; the repository is the archive's name. The driver reads central directories
alone and plans partitions of about ``partitionBytes`` of packed bytes, so one archive is read by several tasks, each of which opens it and reads its own
entries. Entries larger than ``fileBytes`` keep their size and lose their content, as links do. Conditions on ``path`` (equal to, one of, begins with, ends with) are taken
at planning, so entries that they drop are never unpacked; ``contents`` = false reads none.

Folders are opened through Arrow's file systems: local or mounted ones (``file:``), and those of object stores that Arrow knows.
Names that would leave the folder, and archives or contents beyond the limits, fail the read as in ``repository.read_zip``.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from ..functions import fixed

SCHEMA = "repo string, path string, content binary, bytes long, symlink boolean"
#: Entries of a batch.
BATCH = 256


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9]+:/", path) else "file://" + path)


def _clean(name: str) -> str:
    return name.replace("\\", "/")


def _unsafe(name: str) -> bool:
    return name.startswith("/") or bool(re.match("[A-Za-z]:", name)) or "\0" in name or ".." in name.split("/")


class Entries(InputPartition):
    """Entries of one archive that one task reads."""

    def __init__(self, archive: str, top: int, names: list[str]):
        self.archive, self.top, self.names = archive, top, names


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", 8 << 20))
        self.file_bytes = int(options.get("fileBytes", fixed.MAX_FILE_BYTES))
        self.archive_bytes = int(options.get("archiveBytes", fixed.MAX_ARCHIVE_BYTES))
        self.extracted_bytes = int(options.get("extractedBytes", fixed.MAX_EXTRACTED_BYTES))
        self.contents = str(options.get("contents", "true")).lower() == "true"
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the name is Spark's
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def _fits(self, path: str) -> bool:
        def one(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return path == f.value
            if isinstance(f, In):
                return path in f.value
            return path.startswith(f.value) if isinstance(f, StringStartsWith) else path.endswith(f.value)

        return all(one(f) for f in self.wanted)

    def _archives(self) -> list[str]:
        store, path = _opened(self.path)
        if store.get_file_info(path).type == fs.FileType.Directory:
            return sorted(x.path for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith(".zip"))
        return [path]

    def partitions(self) -> list[Entries]:
        store, _ = _opened(self.path)
        out = []
        for archive in self._archives():
            if store.get_file_info(archive).size > self.archive_bytes:
                raise ValueError("ARCHIVE_TOO_LARGE")
            with zipfile.ZipFile(store.open_input_file(archive)) as z:
                entries = [e for e in z.infolist() if not e.is_dir()]
            names = [_clean(e.filename) for e in entries]
            if any(map(_unsafe, names)):
                raise ValueError("PATH_TRAVERSAL_DETECTED")
            if sum(e.file_size for e in entries if e.file_size <= self.file_bytes) > self.extracted_bytes:
                raise ValueError("EXTRACTED_TOO_LARGE")
            # A single folder at the top is taken off.
            tops = {n.split("/", 1)[0] for n in names}
            top = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in n for n in names) else 0
            group: list[str] = []
            size = 0
            for e, n in zip(entries, names, strict=True):
                if not self._fits(n[top:]):
                    continue
                group.append(e.filename)
                size += e.compress_size + 64
                if size >= self.partition_bytes:
                    out.append(Entries(archive, top, group))
                    group, size = [], 0
            if group:
                out.append(Entries(archive, top, group))
        return out

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        repo = re.sub(r"\.zip$", "", partition.archive.rsplit("/", 1)[-1], flags=re.I)
        with zipfile.ZipFile(store.open_input_file(partition.archive)) as z:
            for at in range(0, len(partition.names), BATCH):
                rows = []
                for name in partition.names[at : at + BATCH]:
                    e = z.getinfo(name)
                    link = (e.external_attr >> 28) == 0xA
                    body = z.read(e) if self.contents and e.file_size <= self.file_bytes and not link else b""
                    rows.append((repo, _clean(name)[partition.top :], body, e.file_size, link))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], names=["repo", "path", "content", "bytes", "symlink"])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets Python sources take conditions (Spark refuses a source that can where that is off)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def write_archives(files: DataFrame, folder: str, parts: int = 8) -> None:
    """Files (repo, path, content) as archives ``<repo>-part<k>.zip`` below ``folder``. A repository is cut into ``parts`` by a hash of the path, so a giant one is no
    single task's; entries are written as they come. A task that is run again replaces its own archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        name, z, sink = None, None, None
        for batch in batches:
            for repo, part, path, content in zip(*(batch.column(c).to_pylist() for c in ("repo", "part", "path", "content")), strict=True):
                if (repo, part) != name:
                    if z is not None:
                        z.close()
                        sink.close()
                    name = (repo, part)
                    sink = store.open_output_stream(f"{root}/{repo}-part{part}.zip")
                    z = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                z.writestr(path, content or b"")
        if z is not None:
            z.close()
            sink.close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([True])})

    part = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")
    rows = files.select("repo", part.alias("part"), "path", "content").repartition("repo", "part").sortWithinPartitions("repo", "part")
    rows.mapInArrow(run, "done boolean").count()
