"""Files on any store Arrow knows, opened from the driver or from tasks."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def opened(uri: str) -> Iterator:
    """For random reads."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as src:
        yield src


@contextlib.contextmanager
def created(uri: str) -> Iterator:
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        yield out


def listed(uri: str, suffix: str = "") -> list[str]:
    """Names of the files in a folder, sorted; none where there is no folder."""
    store, path = filesystem(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix))


def removed(uri: str) -> None:
    store, path = filesystem(uri)
    with contextlib.suppress(FileNotFoundError):
        store.delete_file(path)


def renamed(old: str, new: str) -> None:
    store, path = filesystem(old)
    store.move(path, filesystem(new)[1])


def cleared(uri: str) -> None:
    """Deletes a file or a folder with all it holds; nothing where there is none."""
    store, path = filesystem(uri)
    (found,) = store.get_file_info([path])
    if found.type == fs.FileType.Directory:
        store.delete_dir(path)
    elif found.type == fs.FileType.File:
        store.delete_file(path)
