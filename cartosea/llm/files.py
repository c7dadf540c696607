"""Files in the shared folder, by URI, from the driver and from workers."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def move(source: str, target: str) -> None:
    """Rename; a repeated call after success changes nothing."""
    f, a = at(source)
    _, b = at(target)
    if f.get_file_info(a).type != fs.FileType.NotFound:
        f.move(a, b)
    elif f.get_file_info(b).type == fs.FileType.NotFound:
        raise FileNotFoundError(source)


def make(uri: str) -> None:
    """Create a folder and its parents."""
    f, p = at(uri)
    f.create_dir(p, recursive=True)
