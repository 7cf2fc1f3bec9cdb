"""Arrays in files of a shared folder, written by tasks and memory-mapped by tasks."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def local_path(folder: str) -> str | None:
    """The path of a folder that is mounted on every machine, None for other stores."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return None if "://" in folder else folder


def put(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array. A task that runs twice replaces the file with the same content."""
    path = local_path(folder)
    if path is None:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part = f"{base}/{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(memoryview(np.ascontiguousarray(values)).cast("B"))
        store.move(part, f"{base}/{name}")
        return
    os.makedirs(path, exist_ok=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    values.tofile(part)
    os.replace(part, f"{path}/{name}")


class Folder:
    """Memory-mapped arrays of a folder; files of other stores are fetched on first use."""

    def __init__(self, folder: str):
        self.folder = folder
        self.path = local_path(folder)
        self.fetched = None if self.path else tempfile.TemporaryDirectory()
        self.open: dict[str, np.ndarray] = {}

    def array(self, name: str, dtype) -> np.ndarray:
        if name not in self.open:
            path = f"{self.path}/{name}"
            if self.fetched is not None:
                store, base = fs.FileSystem.from_uri(self.folder)
                path = f"{self.fetched.name}/{name}"
                fs.copy_files(f"{base}/{name}", path, source_filesystem=store)
            empty = os.path.getsize(path) == 0
            self.open[name] = np.empty(0, dtype) if empty else np.memmap(path, dtype, "r")
        return self.open[name]
