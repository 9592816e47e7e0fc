"""Files in the shared folder, written and read by tasks through Arrow's file systems.

Names hold a random part, and only names that a finished task reported are ever read, so
a task that is lost or runs twice leaves at most an unused file.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and the path in it; plain paths are local."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


class Writer:
    """One new file of a task."""

    def __init__(self, folder: str, stem: str, ending: str):
        fs, path = opened(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex}.{ending}"
        self.out = fs.open_output_stream(f"{path}/{self.name}", compression=None)  # not by its ending
        self.at = 0

    def write(self, raw) -> int:
        """Append; where it begins."""
        begin = self.at
        self.out.write(raw)
        self.at += len(raw)
        return begin

    def close(self) -> None:
        self.out.close()


class Ranges:
    """Byte ranges of files of a folder; the last file stays open."""

    def __init__(self, folder: str):
        self.fs, self.path = opened(folder)
        self.name, self.file = None, None

    def read(self, name: str, begin: int, length: int) -> bytes:
        if name != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        return self.file.read_at(length, begin)
