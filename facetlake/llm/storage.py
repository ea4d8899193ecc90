"""Files in the shared folder, written and read by tasks through pyarrow's file systems (local, HDFS, S3 and others by URI)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, as ``sharing.new_folder`` gives it. A bare path is a local file; shared folders never are bare."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Sink:
    """A new file whose name has a part of its own for each attempt, so that no attempt of a task writes or moves what another has.

    Which files count is what the manifest says; files of attempts that failed are in none.
    """

    def __init__(self, folder: str, name: str):
        stem, dot, kind = name.partition(".")
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{dot}{kind}"
        self.fs, path = opened(self.uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = self.fs.open_output_stream(path, compression=None)

    def write(self, data: bytes) -> int:
        return self.stream.write(data)

    def tell(self) -> int:
        return self.stream.tell()

    def flush(self) -> None:
        self.stream.flush()

    def close(self) -> None:
        self.stream.close()
