"""Files that tasks write to, and read from, the shared folder, whatever store it is in."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_whole(uri: str, data: bytes) -> None:
    """Write under a temporary name of this attempt, then rename: a reader never sees a part of a
    file, and a repeated task puts the same bytes in the same place."""
    at, path = store(uri)
    folder, _, name = path.rpartition("/")
    tmp = f"{folder}/_tmp-{name}-{uuid.uuid4().hex}"
    with at.open_output_stream(tmp, compression=None) as f:
        f.write(data)
    at.move(tmp, path)


def make_dir(uri: str) -> None:
    at, path = store(uri)
    at.create_dir(path, recursive=True)


def read_range(uri: str, start: int = 0, length: int | None = None) -> bytes:
    at, path = store(uri)
    with at.open_input_file(path) as f:
        return f.read_at(f.size() - start if length is None else length, start)
