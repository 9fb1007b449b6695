"""A sink that writes one array file per row, with a commit: readers see all files of a write or none.

Each task writes into a folder of its own attempt below a staging folder; the commit moves one folder for each task, an
abort leaves nothing. Files go through Arrow's file systems, so any store that those reach will do, not just a mounted folder.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# tasks get the code of their functions with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "name string, bands int, h int, w int, data array<double>"


def _store(path: str):
    """(file system, path inside it)."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.token = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import io

        import numpy as np
        from pyspark import TaskContext

        store, path = _store(self.path)
        task = TaskContext.get()
        folder = f"{path}/_staging-{self.token}/part-{task.partitionId()}-{task.taskAttemptId()}"
        files = 0
        for row in iterator:
            if files == 0:
                store.create_dir(folder, recursive=True)
            content = io.BytesIO()
            values = [float("nan") if v is None else v for v in row.data]
            np.save(content, np.asarray(values, dtype="float64").reshape(row.bands, row.h, row.w))
            with store.open_output_stream(f"{folder}/{row.name}.npy") as out:
                out.write(content.getvalue())
            files += 1
        return _Written(folder, files)

    def commit(self, messages: list) -> None:
        store, path = _store(self.path)
        for n, message in enumerate(m for m in messages if m is not None and m.files):
            store.move(message.folder, f"{path}/part-{self.token}-{n}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, path = _store(self.path)
        staging = f"{path}/_staging-{self.token}"
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class ArrayFiles(DataSource):
    """``df.write.format("array_files").mode("append").save(path)`` for rows of :data:`SCHEMA`."""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("array files are appended; choose a new folder instead of overwriting")
        return _Writer(self.options["path"])


def save(images: DataFrame, path: str) -> None:
    """Write (name, bands, h, w, data) as ``<name>.npy`` below ``path``; missing values become NaN."""
    images.sparkSession.dataSource.register(ArrayFiles)
    images.select("name", "bands", "h", "w", "data").write.format("array_files").mode("append").save(path)
