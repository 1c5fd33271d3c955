"""Small files at addresses that every task reaches, on any file system that ``pyarrow.fs`` knows."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs


def addressed(folder: str) -> str:
    """Folders without a scheme are local ones."""
    return folder if "://" in folder else re.sub(r"^file:/(?!/)|^/", "file:///", folder)


def read(address: str) -> bytes | None:
    """A file's content; None if there is none."""
    fs, path = pyarrow.fs.FileSystem.from_uri(address)
    if fs.get_file_info(path).type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_stream(path, compression=None) as file:
        return file.read()


def write(address: str, content: bytes) -> None:
    """A file that is there whole or not at all: written aside, then moved to its name; whoever moves last stays."""
    fs, path = pyarrow.fs.FileSystem.from_uri(address)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    aside = f"{folder}/.{uuid.uuid4().hex}-{name}"
    with fs.open_output_stream(aside, compression=None) as file:
        file.write(content)
    fs.move(aside, path)


def names(folder: str) -> list[str]:
    """Names of the files in a folder, hidden ones left out."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith("."))


def delete(address: str) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(address)
    if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
        fs.delete_file(path)
