"""Reading and writing whole files and byte ranges from inside tasks.

Tasks write under names of their own (a random part), and only files named in a
manifest row of a finished task are ever read, so a repeated or lost task
attempt leaves nothing that counts.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def write(uri: str, data: bytes) -> None:
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


class Sink:
    """An output stream that knows how far it has come."""

    def __init__(self, uri: str):
        system, path = _at(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.at, self._out = uri, 0, system.open_output_stream(path, compression=None)

    def put(self, data: bytes) -> int:
        begin = self.at
        self._out.write(data)
        self.at += len(data)
        return begin

    def close(self) -> None:
        self._out.close()


class Source:
    """Byte ranges of one file."""

    def __init__(self, uri: str):
        system, path = _at(uri)
        self._in = system.open_input_file(path)

    def size(self) -> int:
        return self._in.size()

    def range(self, begin: int, length: int) -> bytes:
        return self._in.read_at(length, begin)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._in.close()
