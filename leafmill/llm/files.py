"""Files in the shared folder, from driver or executors, for any store that Arrow can reach."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def make_folder(uri: str) -> None:
    system, path = at(uri)
    system.create_dir(path, recursive=True)


def fresh_name(stem: str) -> str:
    """A name that no other attempt of the same task uses."""
    return f"{stem}-{uuid.uuid4().hex[:12]}"


def write(uri: str, parts: list[bytes]) -> int:
    system, path = at(uri)
    with system.open_output_stream(path, compression=None) as out:
        for p in parts:
            out.write(p)
    return sum(map(len, parts))


def read(uri: str, start: int = 0, length: int | None = None) -> bytes:
    system, path = at(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()
