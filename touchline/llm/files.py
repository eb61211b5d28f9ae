"""Binary files of any store: written by tasks under names of their own, listed in a manifest table, read as streams."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def opened(uri: str, write: bool = False):
    """A stream of the file at ``uri``; folders are made for writing."""
    store, path = fs.FileSystem.from_uri(uri)
    if write:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_stream(path, compression=None)


def opened_at_random(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def own_name(folder: str, suffix: str) -> str:
    """A file that only this attempt of this task writes: a repeated task leaves no doubt about which file counts."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    return f"{folder}/part-{part:05d}-{uuid.uuid4().hex}{suffix}"
