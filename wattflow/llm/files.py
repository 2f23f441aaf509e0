"""Files that tasks write below the shared folder, through the file systems that pyarrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it; the folder is made."""
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    system.create_dir(path, recursive=True)
    return system, path


def unique(stem: str, ending: str) -> str:
    """A name that no other attempt of the same task uses; only names in a finished task's result count."""
    return f"{stem}-{uuid.uuid4().hex}{ending}"
