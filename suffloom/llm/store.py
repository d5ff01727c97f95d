"""Files of arrays in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import numpy as np

from suffloom.llm.common import local_path


class ArrayStore:
    """Arrays by name below a folder that all workers reach.

    Where the folder is mounted, files are mapped in place. Else (an object store) a worker
    copies a file to its own temporary folder before it maps it; that folder goes with the
    worker. A file appears whole or not at all, so that a task run twice does no harm.
    """

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self._copies: str | None = None
        self._open: dict[tuple[str, str], np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"uri": self.uri, "_copies": None, "_open": {}}

    def put(self, name: str, values: np.ndarray) -> None:
        folder = local_path(self.uri)
        if folder is None:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(f"{self.uri}/{name}")
            with system.open_output_stream(path) as out:
                out.write(np.ascontiguousarray(values).tobytes())
            return
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.ascontiguousarray(values).tofile(out)
        os.replace(part, f"{folder}/{name}")

    def get(self, name: str, kind: str) -> np.ndarray:
        """A read-only map of the file; an empty array for an empty file. Maps stay open: they take no memory of the worker's own."""
        if (name, kind) not in self._open:
            self._open[name, kind] = self._map(name, kind)
        return self._open[name, kind]

    def _map(self, name: str, kind: str) -> np.ndarray:
        folder = local_path(self.uri)
        if folder is None:
            path = self._copied(name)
        else:
            path = f"{folder}/{name}"
        if os.path.getsize(path) == 0:
            return np.zeros(0, kind)
        return np.memmap(path, kind, "r").view(np.ndarray)

    def _copied(self, name: str) -> str:
        from pyarrow import fs

        if self._copies is None:
            self._copies = tempfile.mkdtemp()
            atexit.register(shutil.rmtree, self._copies, ignore_errors=True)
        target = f"{self._copies}/{name}"
        if not os.path.exists(target):
            system, path = fs.FileSystem.from_uri(f"{self.uri}/{name}")
            with system.open_input_stream(path) as src, open(target, "wb") as out:
                shutil.copyfileobj(src, out, 1 << 20)
        return target
