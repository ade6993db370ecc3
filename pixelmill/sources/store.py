"""Files as a sink that commits as a whole: a data source that writes rows ``(name, content)``.

``df.write.format("pixelmill_files").mode("append").save(folder)`` makes a file of each run of rows with one name. Tasks write
into a staging folder below the target; only if all have ended well does the driver move the files into place, and it
puts back what it has moved if that fails. So a job leaves all of its files or none, whatever tasks are lost, run again
or run twice, and a job that runs again leaves the same files.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from pixelmill.runtime import ship

FORMAT = "pixelmill_files"
#: Files that the driver moves at a time.
MOVERS = 16


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: (name, place in the staging folder) of each file."""

    files: list[tuple[str, str]]


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system, and its path there."""
    store, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
    return store, root.rstrip("/")


def _checked(name: str | None) -> str:
    if not name or name.startswith("/") or "\\" in name or any(part in ("", ".", "..") for part in name.split("/")):
        raise ValueError(f"not a file name below the folder: {name!r}")
    return name


class FileWriter(DataSourceArrowWriter):
    """One job's writer. ``append`` refuses names that are there, ``overwrite`` replaces them; other files stay."""

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, f"_staging-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return opened(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = self._store()
        place = f"{root}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(place, recursive=False)  # fails once the job's folder is gone, so that a task that outlives its job leaves nothing
        files: list[tuple[str, str]] = []
        out = None
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name"), batch.column("content")):
                    name = _checked(name.as_py())
                    if not files or files[-1][0] != name:
                        if out is not None:
                            out.close()
                        files.append((name, f"{place}/{len(files)}"))
                        out = store.open_output_stream(files[-1][1])
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out is not None:
                out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self._store()
        staged = [f for m in messages if m is not None for f in m.files]
        names = [name for name, _ in staged]
        if len(set(names)) < len(names):
            seen: set[str] = set()
            twice = next(n for n in names if n in seen or seen.add(n))
            raise ValueError(f"several files of one name: {twice}")
        with ThreadPoolExecutor(MOVERS) as pool:
            there = [i.path for i in store.get_file_info([f"{root}/{n}" for n in names]) if i.type != fs.FileType.NotFound] if names else []
            if there and not self.overwrite:
                raise FileExistsError(f"{len(there)} files are there already, such as {there[0]}")
            for parent in sorted({n.rpartition("/")[0] for n in names} - {""}):
                store.create_dir(f"{root}/{parent}", recursive=True)
            kept = [(path, f"{root}/{self.job}/was-{k}") for k, path in enumerate(there)]
            moves = kept + [(place, f"{root}/{name}") for name, place in staged]
            done = []

            def move(pair: tuple[str, str]) -> None:
                store.move(*pair)
                done.append(pair)

            try:
                list(pool.map(move, kept))
                list(pool.map(move, moves[len(kept) :]))
            except BaseException:
                for source, target in reversed(done):
                    store.move(target, source)
                raise
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def begin(self) -> FileWriter:
        """Makes the job's staging folder, on the driver."""
        store, root = self._store()
        store.create_dir(f"{root}/{self.job}", recursive=True)
        return self

    def _clear(self) -> None:
        store, root = self._store()
        for wait in (0.1, 0.5, 2.0, None):  # tasks that still run may be writing there
            try:
                if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
                    store.delete_dir(f"{root}/{self.job}")
                return
            except OSError:
                if wait is None:
                    raise
                time.sleep(wait)


class FileSink(DataSource):
    """``path`` is a folder's path or address that pyarrow's file systems open from driver and executors."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: object, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite).begin()


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes ``files(name, content)``: rows of one name that follow each other in a partition are one file."""
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(FileSink)
    files.select("name", "content").write.format(FORMAT).mode("overwrite" if overwrite else "append").save(folder)


def _scan(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(~F.col("path").contains("/_staging-"))


def paths_in(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """``path`` of the files below ``folder`` that are not empty, for readers that open them (``opened``) and take them in parts."""
    return _scan(spark, folder).select("path")


def files_in(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """``name, size, content`` of the files below ``folder`` that are not empty; without ``content`` in what follows no file is opened."""
    got = _scan(spark, folder)
    root = opened(folder)[1] + "/"
    name = F.substring_index("path", root, -1)
    return got.select(name.alias("name"), F.col("length").alias("size"), "content")
