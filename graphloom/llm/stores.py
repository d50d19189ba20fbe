"""Files in the shared folder, opened from within tasks."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs

#: Hadoop's names of stores that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, or of a local path."""
    scheme, sep, rest = uri.partition("://")
    if not sep and uri.startswith("file:"):
        scheme, sep, rest = "file", "://", "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + sep + rest)


def task_file(folder: str, suffix: str) -> str:
    """A name for a new file of this task attempt; no other attempt has it."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return posixpath.join(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}")


class Output:
    """A new file that knows how much has been written."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        system.create_dir(posixpath.dirname(path), recursive=True)
        self.uri, self.at, self._stream = uri, 0, system.open_output_stream(path, compression=None)

    def write(self, data: bytes) -> int:
        """Append; the place where the data starts."""
        at = self.at
        self._stream.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self._stream.close()


class Input:
    """Range reads; the file opened last stays open."""

    def __init__(self):
        self.uri, self._file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = opened(uri)
            self._file, self.uri = system.open_input_file(path), uri
        found = self._file.read_at(length, offset)
        if len(found) != length:
            raise ValueError(f"{uri} ends before {offset + length}")
        return found

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self.uri, self._file = None, None
