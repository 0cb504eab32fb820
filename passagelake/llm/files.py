"""Files of an operator's own format, in the folder that all executors share."""

from __future__ import annotations

import uuid


def open_store(uri: str):
    """``(filesystem, path)`` of a folder named by URI or by plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Staged:
    """A file that takes its name only when it is complete.

    Each attempt writes under a name of its own and moves it last, so that a task which is
    run again, or twice at once, leaves one whole file.
    """

    def __init__(self, uri: str, name: str):
        self.store, folder = open_store(uri)
        self.store.create_dir(folder, recursive=True)
        self.path = f"{folder}/{name}"
        self.attempt = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.attempt)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def commit(self) -> None:
        self.out.close()
        self.store.move(self.attempt, self.path)

    def abandon(self) -> None:
        self.out.close()
        self.store.delete_file(self.attempt)
