"""Files in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyarrow import fs as pafs

from ..sources.shared import arrow_fs, run_dir, stored

__all__ = ["free_name", "get", "names", "put", "release", "resident", "run_dir", "stored"]

def free_name(name: str, columns: list[str]) -> str:
    """A column name that is not among these."""
    while name in columns:
        name = "_" + name
    return name


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file under a name of its own, then move it: a repeated task leaves the same whole file."""
    fs, path = arrow_fs(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{path}/{name}")


def get(folder: str, name: str) -> bytes:
    fs, path = arrow_fs(folder)
    with fs.open_input_stream(f"{path}/{name}") as file:
        return file.read()


def names(folder: str) -> dict[str, int]:
    """Whole files of a folder and their sizes."""
    fs, path = arrow_fs(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return {x.base_name: x.size for x in found if x.is_file and not x.base_name.startswith(".")}


_resident: dict[tuple[str, str], object] = {}


def resident(kind: str, path: str, make):
    """A Python worker's one large table: workers serve many stages, so another table's cache goes when a new one comes."""
    if (kind, path) not in _resident:
        release()
        _resident[kind, path] = make(path)
    return _resident[kind, path]


def release() -> None:
    """For stages that need no table of a vocabulary: let go of what the worker kept from a stage before, and give its memory back."""
    if _resident:
        _resident.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
