"""Files by path or URI: opened for positional reads, listed and moved, by tasks as well as by the driver.

Local paths, ``file:``, ``hdfs:``, ``viewfs:``, ``s3:``, ``gs:`` and ``abfs:`` go through Arrow's file systems, so nothing has
to be mounted on the executors.
"""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import cache
from typing import Any

from pyarrow import fs
from pyspark.sql import SparkSession

SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")


@cache
def _system(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0]


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; what has no scheme is local."""
    if not SCHEME.match(path) or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    scheme, _, rest = path.partition(":")
    host = rest.lstrip("/").split("/", 1)[0]
    system = _system(f"{scheme}://{host}/")
    own = fs.FileSystem.from_uri(path)[1]
    return system, own


def opened(path: str) -> Any:
    """A file to seek and read in."""
    system, own = located(path)
    return system.open_input_file(own)


@dataclass(frozen=True, order=True)
class Listed:
    path: str
    size: int
    time: int  # of the last change, in nanoseconds


def listed(path: str) -> list[Listed]:
    """All files under a folder (or the one file), in the order of their paths; hidden ones and those in hidden folders are left out."""
    system, own = located(path)
    head = path[: len(path.rstrip("/")) - len(own.rstrip("/"))] if path.rstrip("/").endswith(own.rstrip("/")) else ""
    at = system.get_file_info(own)
    found = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, recursive=True)) if at.type == fs.FileType.Directory else []
    inside = lambda p: p[len(own) :] if p != own else ""
    hidden = lambda p: any(part[:1] in ("_", ".") for part in inside(p).split("/") if part)
    return sorted(Listed(head + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and not hidden(f.path))


def write_file(path: str, data: bytes, made: bool = False) -> None:
    """``made``: its folder is there."""
    system, own = located(path)
    if not made:
        system.create_dir(posixpath.dirname(own), recursive=True)
    with system.open_output_stream(own) as f:
        f.write(data)


def exists(path: str) -> bool:
    system, own = located(path)
    return system.get_file_info(own).type != fs.FileType.NotFound


def move(old: str, new: str) -> None:
    system, a = located(old)
    b = located(new)[1]
    system.create_dir(posixpath.dirname(b), recursive=True)
    system.move(a, b)


def remove(path: str) -> None:
    """Removes a folder with all that is in it; one that is not there is no error."""
    system, own = located(path)
    if system.get_file_info(own).type == fs.FileType.Directory:
        system.delete_dir(own)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; a temporary one on a local master without it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodestream-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
