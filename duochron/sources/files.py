"""Byte-wise access to files from tasks, for formats that Spark's readers do not know."""

from __future__ import annotations

import pyarrow.fs as pafs

# Spark's name of a scheme -> the name pyarrow knows it by; no scheme means a mounted path.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def scheme(path: str) -> str:
    """The scheme of a path as Spark writes it; a plain path is a file."""
    return path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else "file"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it. `file:/x` is read as `file:///x`."""
    kind = scheme(path)
    if kind not in SCHEMES:
        raise ValueError(f"no byte access to {path}: its scheme is none of {', '.join(SCHEMES)}")
    if kind == "file":
        rest = path[5:] if path.startswith("file:") else path
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest
    return pafs.FileSystem.from_uri(SCHEMES[kind] + path[len(kind) :])
