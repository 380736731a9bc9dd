"""Files in the folder that driver and executors share, written and read by tasks."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

import pyarrow.fs as pafs

from spanlens.sources.scratch import drop, materialize, new_folder, release, shared_root

__all__ = ["drop", "materialize", "new_folder", "open_store", "publish", "release", "shared_root"]


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path (file, hdfs, s3, gs) and the path within it."""
    scheme = urlsplit(path).scheme
    if not scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), urlsplit(path).path
    return pafs.FileSystem.from_uri(path)


def publish(path: str, write) -> None:
    """Call ``write(stream)`` for a new file; a failed attempt leaves only a ``.part`` file."""
    store, inner = open_store(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, inner)
