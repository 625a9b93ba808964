"""Files of this machine's folders and of stores that Arrow reaches, opened one by one."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem


def of(path: str) -> tuple[FileSystem, str]:
    """The store of a path as Spark gives it, and the path's name there."""
    if "://" not in path or path.startswith("file:"):
        local = path.removeprefix("file:")
        return LocalFileSystem(), local[2:] if local.startswith("///") else local
    return FileSystem.from_uri(quote(path, safe=":/@%"))


def parts(folder: str) -> list[str]:
    """The files that Spark's writer left in a folder, in the order of its tasks."""
    store, name = of(folder)
    found = [(int(m[1]), f.base_name, f.path) for f in store.get_file_info(FileSelector(name)) if f.type == FileType.File and (m := re.match(r"part-(\d+)", f.base_name))]
    return [path for _, _, path in sorted(found)]


def blocks(folder: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of the parts of a folder, one after another."""
    store, _ = of(folder)
    for path in parts(folder):
        with store.open_input_stream(path) as f:
            while block := f.read(size):
                yield block


def write(path: str, blocks: Iterable[bytes]) -> None:
    """A file of blocks of bytes, in a folder that is made where it isn't there."""
    store, name = of(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name) as f:
        for block in blocks:
            f.write(block)
