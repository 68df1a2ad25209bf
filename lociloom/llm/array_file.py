"""Named arrays in one file, for memory-mapping; written to and read from any store that Arrow reaches."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import struct
import tempfile
import uuid

import numpy as np
import pyarrow.fs

MAGIC, ALIGN = b"ARRAYS01", 64
_copied: dict[str, str] = {}


def as_uri(folder: str) -> str:
    """The folder as Arrow names it; a plain path is one of the machine's own (in tests)."""
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes the arrays to a file of its own below folder and gives its URI; a task that runs again writes another."""
    store, where = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(where, recursive=True)
    name = f"{name}-{uuid.uuid4().hex[:12]}.arrays"
    parts, at = {}, 0
    for k, a in arrays.items():
        parts[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // ALIGN) * ALIGN
    head = json.dumps(parts).encode()
    head += b" " * (-(len(head) + 12) % ALIGN)
    with store.open_output_stream(f"{where}/{name}") as f:
        f.write(MAGIC + struct.pack("<I", len(head)) + head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(bytes(-a.nbytes % ALIGN))
    return f"{folder.rstrip('/')}/{name}"


def _local(uri: str) -> str:
    """The file's path on this machine: its own where the folder is mounted, else a copy that goes when the worker ends."""
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return path
    if uri not in _copied:
        folder = tempfile.mkdtemp(prefix="lociloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _copied[uri] = f"{folder}/{os.path.basename(path)}"
        pyarrow.fs.copy_files(uri, _copied[uri])
    return _copied[uri]


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays as read-only memory maps."""
    path = _local(uri)
    whole = np.memmap(path, np.uint8, "r")
    if whole[:8].tobytes() != MAGIC:
        raise ValueError(f"{path} is not a file of arrays")
    (size,) = struct.unpack("<I", whole[8:12].tobytes())
    parts = json.loads(whole[12 : 12 + size].tobytes())
    start = 12 + size
    return {k: whole[start + at : start + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in parts.items()}
