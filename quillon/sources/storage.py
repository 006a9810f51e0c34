"""Files that Python workers look up and write on storage that all of them share (CMP9): a path, or a URI that pyarrow knows."""

from __future__ import annotations

import hashlib
import shutil
import uuid
from typing import BinaryIO


def resolve(path: str):
    """(file system, path there)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    from pyarrow import fs

    store, at = resolve(path)
    return store.get_file_info(at).type == fs.FileType.File


def read_bytes(path: str) -> bytes | None:
    """A small file; None if there is none."""
    store, at = resolve(path)
    try:
        with store.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def write_stream(path: str, source: BinaryIO) -> None:
    """The file is written beside its place and moved there once it is whole."""
    store, at = resolve(path)
    store.create_dir(at.rpartition("/")[0] or ".", recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as target:
        shutil.copyfileobj(source, target)
    store.move(part, at)


def marker(log: str, path: str) -> str:
    """Where a log folder notes which run fetched a file; folders stay small."""
    name = hashlib.sha1(path.encode()).hexdigest()
    return f"{log.rstrip('/')}/{name[:3]}/{name}"
