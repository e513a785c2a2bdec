"""Files opened inside the tasks, by the paths that Spark gives them."""

from __future__ import annotations

import os
import re

import pyarrow.fs


def _local(path: str) -> str | None:
    found = re.match("(?:file:/{0,2})?(/.*)", path)
    return found and found[1]


def open_path(path: str, mode: str = "rb"):
    """A file on a local or shared disk, or in any store that Arrow knows."""
    if _local(path):
        return open(_local(path), mode)
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_stream(name) if mode == "rb" else store.open_output_stream(name)


def make_folder(path: str) -> None:
    """The folder and those above it; in order if it is there."""
    if _local(path):
        os.makedirs(_local(path), exist_ok=True)
    else:
        store, name = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(name)
