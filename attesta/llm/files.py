"""Output files that tasks write to a shared folder."""

from __future__ import annotations

import sys
import types
import uuid
from typing import BinaryIO
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from attesta.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def one_file_a_task(manifest: DataFrame, *order: str) -> DataFrame:
    """The rows of a stored manifest, each in a partition of its own.

    A row is small and its file is not, so the number is given: Spark would pack partitions by the size of the rows.
    """
    return manifest.repartitionByRange(max(manifest.count(), 1), *order)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker. Functions of this package come with each task anew."""
    name = "attesta_worker_cache"
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    scheme = urlsplit(uri).scheme
    if not scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Output:
    """A file that no reader sees before it is whole: written under a name of its own, then moved.

    A task that is run again writes another file, and only the file that its manifest row names is read.
    """

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.files, self.path = _at(self.uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.files.open_output_stream(self.path + ".part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.stream.close()
        self.files.move(self.path + ".part", self.path)
        return self.uri


def open_input(uri: str, seekable: bool = False) -> BinaryIO:
    files, path = _at(uri)
    return files.open_input_file(path) if seekable else files.open_input_stream(path, compression=None, buffer_size=1 << 20)
