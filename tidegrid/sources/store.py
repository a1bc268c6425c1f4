"""Small text files and folders beside the data, local or in any store that ``pyarrow.fs`` knows by URI."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyarrow import fs as pafs

Location = str | Path


def place(at: Location) -> tuple[pafs.FileSystem, str]:
    """The store of a location and its path there; without a scheme it is a local file."""
    text = str(at)
    return pafs.FileSystem.from_uri(text) if "://" in text else (pafs.LocalFileSystem(), text)


def join(folder: Location, name: str) -> str:
    return name if name.startswith("/") or "://" in name else f"{str(folder).rstrip('/')}/{name}"


def kind(at: Location) -> pafs.FileType:
    store, path = place(at)
    return store.get_file_info(path).type


def exists(at: Location) -> bool:
    return kind(at) != pafs.FileType.NotFound


def make_folder(at: Location) -> None:
    store, path = place(at)
    store.create_dir(path, recursive=True)


def remove_folder(at: Location) -> None:
    """The folder and what is in it, if it is there."""
    store, path = place(at)
    if store.get_file_info(path).type == pafs.FileType.Directory:
        store.delete_dir(path)


def read_text(at: Location) -> str:
    store, path = place(at)
    with store.open_input_stream(path) as f:
        return f.read().decode("utf-8")


def write_text(at: Location, text: str) -> None:
    """Write beside the target and rename: a crash leaves the old file or the new one, never a part of one."""
    store, path = place(at)
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/tmp.{uuid.uuid4().hex}.{name}" if folder else f"tmp.{uuid.uuid4().hex}.{name}"
    with store.open_output_stream(draft) as f:
        f.write(text.encode("utf-8"))
    store.move(draft, path)
