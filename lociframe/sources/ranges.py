"""Files that tasks read by byte ranges."""

from __future__ import annotations

from pyarrow import fs


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def listed(path: str, suffix: str) -> list[str]:
    """The files of a folder that end so, or path itself if it is a file."""
    where, name = _place(path)
    if where.get_file_info(name).type == fs.FileType.File:
        return [path]
    front = path[: len(path) - len(name)] if path.endswith(name) else "file://"
    return sorted(front + f.path for f in where.get_file_info(fs.FileSelector(name)) if f.path.endswith(suffix))


def opened(path: str):
    """A file that can be read at any place, on any store that pyarrow reaches."""
    where, name = _place(path)
    return where.open_input_file(name)


def written(path: str, data: bytes) -> None:
    """A file of data, which appears whole: a task that is lost or run twice leaves no half of one."""
    where, name = _place(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name + ".part") as out:
        out.write(data)
    where.move(name + ".part", name)
