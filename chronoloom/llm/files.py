"""Files that Python workers write below a shared folder, by path or by URI."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    """The path if the URI names a mounted file system, else None."""
    at = urlparse(uri)
    return unquote(at.path) if at.scheme in ("", "file") else None


def put(uri: str, write) -> None:
    """``write(file)`` into a new file that appears under its name only when whole.

    A task that runs twice writes the same name twice, with the same content.
    """
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
        with open(part, "wb") as f:
            write(f)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.urandom(8).hex()}.tmp"
    with store.open_output_stream(part) as f:
        write(f)
    store.move(part, path)


def mapped(uri: str, dtype: str):
    """A file of numbers, memory-mapped; one in a remote store is read into memory, never onto this machine's disk."""
    import numpy as np

    if (path := local_path(uri)) is None:
        from pyarrow import fs

        store, far = fs.FileSystem.from_uri(uri)
        with store.open_input_file(far) as f:
            return np.frombuffer(f.read_buffer(), dtype)
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
