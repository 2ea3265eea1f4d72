"""Writing made files: rows of ``(name, content)`` become files of a folder, all or none.

    spark.dataSource.register(FileSink)
    cleaned_files(...).write.format("whole_files").mode("append").save("file:///out")

Each task writes to a folder of its own beside the others. When all are done the driver moves
the files of the attempts that counted to their names; if the job fails it removes the lot, so
a reader never sees a part of it and a lost executor leaves nothing behind. The folder may lie
wherever ``pyarrow.fs`` reaches and driver and executors share it.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING, DONE = "_staging", "_SUCCESS"


def plain_name(name: str | None) -> str:
    """A file name without folders: what stands after the last slash or backslash; names
    that are empty, hidden or begin like the folder's own are prefixed."""
    last = re.split(r"[/\\]", name or "")[-1].replace("\0", "")
    return last if last.strip(". ") and last[0] not in "._" else f"file{last.strip()}"


def free_names(names: list[str], taken: set[str]) -> list[str]:
    """Each name, numbered before its ending where it is taken: ``a.txt``, ``a (2).txt``."""
    out = []
    for name in names:
        stem, ending = posixpath.splitext(name)
        n, free = 1, name
        while free in taken:
            n += 1
            free = f"{stem} ({n}){ending}"
        taken.add(free)
        out.append(free)
    return out


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task: where each lies, and its name."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Staged:
        system, root = self.place()
        mine = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(mine, recursive=True)
        files = []
        for row in iterator:
            at = f"{mine}/{len(files)}"
            with system.open_output_stream(at) as out:
                out.write(bytes(row["content"] or b""))
            files.append((at, plain_name(row["name"])))
        return Staged(files)

    def there(self, system: fs.FileSystem, root: str) -> list[str]:
        return [f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves a file at a time; the marker comes last. Repeated names are numbered in the
        order of the job's partitions. The driver holds the names of the files, not more."""
        system, root = self.place()
        system.create_dir(root, recursive=True)
        if system.get_file_info(f"{root}/{DONE}").type == fs.FileType.File:
            system.delete_file(f"{root}/{DONE}")
        before = self.there(system, root)
        if self.overwrite:
            for name in before:
                system.delete_file(f"{root}/{name}")
            before = []
        files = [f for m in messages if m for f in m.files]
        for (at, _), name in zip(files, free_names([n for _, n in files], set(before)), strict=True):
            system.move(at, f"{root}/{name}")
        self.clean(system, root)
        with system.open_output_stream(f"{root}/{DONE}"):
            pass

    def abort(self, messages: list[Staged | None]) -> None:
        self.clean(*self.place())

    def clean(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGING}/{self.job}")
        rest = system.get_file_info(fs.FileSelector(f"{root}/{STAGING}", allow_not_found=True))
        if not rest and system.get_file_info(f"{root}/{STAGING}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGING}")


class FileSink(DataSource):
    """Takes rows with ``name`` and ``content``; a null name or content is an empty one, a name
    that is there already is numbered, other columns don't matter."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        missing = {"name", "content"} - set(schema.names)
        if missing or "path" not in self.options:
            raise ValueError(f"a file sink needs a path and columns name and content; missing: {', '.join(sorted(missing)) or 'path'}")
        return FileWriter(self.options["path"].rstrip("/"), overwrite)
