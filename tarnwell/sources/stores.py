"""Folders in any store that pyarrow opens; little is imported here, as workers import it."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.fs


def store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder by its URI or local path, and the folder's path there."""
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else Path(folder).resolve().as_uri())
