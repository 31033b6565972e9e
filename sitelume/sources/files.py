"""Byte ranges of files from within tasks: Python's data sources read by these, not by Spark's readers.

A path without a scheme is a local or mounted one; with a scheme (file, hdfs, s3, gs, abfs) the file system
is Arrow's. Every executor has to see the same files.
"""

from __future__ import annotations

from pyarrow import NativeFile, fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def size(path: str) -> int:
    """Bytes of a file; -1 if there is none."""
    system, at = filesystem(path)
    info = system.get_file_info(at)
    return info.size if info.type == fs.FileType.File else -1


def names(folder: str) -> list[str]:
    """Files right in a folder, in order; none if there is no folder."""
    system, at = filesystem(folder)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(x.base_name for x in found if x.type == fs.FileType.File)


def read(path: str, start: int = 0, length: int | None = None) -> bytes:
    """length bytes from start on, fewer at the file's end."""
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        rest = max(0, f.size() - start)
        return f.read_at(rest if length is None else min(length, rest), start) if rest else b""


def write(path: str, data: bytes) -> None:
    with writing(path) as f:
        f.write(data)


def remove(path: str) -> None:
    system, at = filesystem(path)
    system.delete_file(at)


def writing(path: str) -> NativeFile:
    """A file to be written piece by piece, as it is: a name in .gz isn't a wish."""
    system, at = filesystem(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at, compression=None)


def move(path: str, to: str) -> None:
    """Rename a file, over another one if there is one."""
    system, at = filesystem(path)
    system.move(at, filesystem(to)[1])


def remove_folder(path: str) -> None:
    system, at = filesystem(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)
