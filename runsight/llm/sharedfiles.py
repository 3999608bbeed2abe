"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(folder: str, name: str, data: bytes) -> str:
    """Write a file below ``folder`` (a path or URI all executors see) and return its URI.

    Each attempt of a task takes a new name, and only names that a finished task returned are ever read, so repeated or lost attempts do no harm.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}-{name}"
    with system.open_output_stream(fs.FileSystem.from_uri(uri)[1], compression=None) as out:  # bytes as they are, whatever the name
        out.write(data)
    return uri


def get(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()


def place(folder: str, name: str, data: bytes) -> str:
    """Write a file under a fixed name: whole under another name first, then moved, so that a reader sees all of it and repeated attempts end alike."""
    uri = put(folder, name, data)
    system, path = fs.FileSystem.from_uri(uri)
    target = f"{folder.rstrip('/')}/{name}"
    system.move(path, fs.FileSystem.from_uri(target)[1])
    return target
