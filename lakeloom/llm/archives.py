"""Files of archive members in any store that pyarrow can reach.

A writer collects members in memory up to a size, puts the file under a temporary name
and moves it to its final one, so a reader never meets half a file and a task that runs
again replaces its own files by the same ones.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; a plain path is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def local_uri(path: str) -> str:
    """file:/x as Hadoop writes it, in the form file:///x."""
    return "file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path


def put(uri: str, data: bytes) -> None:
    store, path = open_store(local_uri(uri))
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/_{name}.{uuid.uuid4().hex[:8]}"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)


def fetch(uri: str, offset: int = 0, size: int | None = None) -> bytes:
    """Bytes of a file as they are stored."""
    store, path = open_store(local_uri(uri))
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read() if size is None else f.read(size)


def list_files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(uri, size) of the finished files directly in a folder, in order."""
    store, path = open_store(local_uri(uri))
    found = store.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
    return sorted((f"{uri.rstrip('/')}/{f.base_name}", f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] not in "_.")
