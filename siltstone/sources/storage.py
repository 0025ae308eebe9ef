"""Files for the sources, by path or URI: local ones, HDFS and whatever else Arrow's file systems reach.

Both the driver, which plans, and the tasks, which read, open files this way; a path without a scheme
is local and must be shared by all of them.  Arrow's file systems are loaded for other schemes only, as
they start threads, which a process that forks its workers had better not have.
"""

from __future__ import annotations

import fnmatch
import os
import re

from siltstone.errors import SiltstoneError

_WILD = re.compile(r"[*?\[]")


class Local:
    """Files of this machine or of what is mounted on it."""

    def open(self, path: str):
        return open(path, "rb")

    def entries(self, folder: str) -> list[tuple[str, int, bool]]:
        if not os.path.isdir(folder):
            return []
        with os.scandir(folder) as found:
            return [(e.name, 0 if e.is_dir() else e.stat().st_size, e.is_dir()) for e in found]

    def write(self, path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.tmp", "wb") as out:
            out.write(data)
        os.replace(f"{path}.tmp", path)


class Remote:
    """Files of one of Arrow's file systems."""

    def __init__(self, system):
        self.system = system

    def open(self, path: str):
        return self.system.open_input_file(path)

    def entries(self, folder: str) -> list[tuple[str, int, bool]]:
        from pyarrow import fs

        return [(f.base_name, f.size or 0, f.type == fs.FileType.Directory) for f in self.system.get_file_info(fs.FileSelector(folder, allow_not_found=True))]

    def write(self, path: str, data: bytes) -> None:
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.system.open_output_stream(f"{path}.tmp") as out:
            out.write(data)
        self.system.move(f"{path}.tmp", path)


def locate(path: str) -> tuple[Local | Remote, str, str]:
    """File system, path within it, and what to put before such a path to get the name of a file back."""
    if path.startswith("file:"):
        return Local(), re.sub(r"^file:(//)?", "", path), "file://"
    if "://" not in path:
        return Local(), path, ""
    from pyarrow import fs

    head = re.split(_WILD, path)[0]
    system, inner = fs.FileSystem.from_uri(head)
    return Remote(system), inner + path[len(head) :], head[: len(head) - len(inner)]


def open_file(path: str):
    """A file for reading at any position."""
    system, inner, _ = locate(path)
    try:
        return system.open(inner)
    except OSError as e:
        raise SiltstoneError("IO", details=f"{path}: {e}") from e


def read_file(path: str) -> bytes:
    with open_file(path) as file:
        return file.read()


def entries(folder: str) -> list[tuple[str, int, bool]]:
    """(name, size, whether it is a folder) of what a folder has; nothing where there is none."""
    system, inner, _ = locate(folder)
    return system.entries(inner or "/")


def expand(pattern: str) -> list[str]:
    """The paths that match a pattern with * ? [], sorted; a pattern without them as it is."""
    if not _WILD.search(pattern):
        return [pattern]
    system, inner, head = locate(pattern)
    found = ["/"] if inner.startswith("/") else [""]
    for part in [p for p in inner.split("/") if p]:
        following = []
        for folder in found:
            # A name without wildcards is taken as it is: whether it exists is told when it is opened.
            names = [n for n, _, _ in system.entries(folder or ".") if fnmatch.fnmatchcase(n, part)] if _WILD.search(part) else [part]
            following += [f"{folder}{'/' if folder and not folder.endswith('/') else ''}{n}" for n in names]
        found = following
    return sorted(head + f for f in found)


def write_file(path: str, data: bytes) -> None:
    """A whole small file, written beside it and moved, so that readers see all of it or nothing."""
    system, inner, _ = locate(path)
    system.write(inner, data)
