"""Files wherever Spark reaches them: local, HDFS and object stores, through Hadoop's file system."""

from __future__ import annotations

import io

from ..plans.session import session
from .readers import exists as _exists, file_system, is_directory


def exists(path: str) -> bool:
    return _exists(session(), path)


def is_dir(path: str) -> bool:
    return exists(path) and is_directory(session(), path)


def is_file(path: str) -> bool:
    return exists(path) and not is_directory(session(), path)


def list_dir(path: str) -> list[str]:
    """Names in a folder, in order."""
    fs, where = file_system(session(), path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where))


def length(path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, where = file_system(session(), path)
    return int(fs.getContentSummary(where).getLength())


def modified(path: str) -> float:
    """Seconds since 1970."""
    fs, where = file_system(session(), path)
    return fs.getFileStatus(where).getModificationTime() / 1000


def make_dir(path: str) -> bool:
    fs, where = file_system(session(), path)
    return bool(fs.mkdirs(where))


def rename(old: str, new: str) -> bool:
    fs, where = file_system(session(), old)
    return bool(fs.rename(where, file_system(session(), new)[1]))


def delete(path: str, recursive: bool = False) -> bool:
    fs, where = file_system(session(), path)
    return bool(fs.delete(where, recursive))


def read_bytes(path: str) -> bytes:
    """A small file's content, through the driver."""
    row = session().read.format("binaryFile").load(path).select("content").first()
    return bytes(row[0])


def write_bytes(path: str, content: bytes) -> None:
    fs, where = file_system(session(), path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def open_file(path: str, mode: str = "r"):
    """A small file for reading, as text or bytes."""
    if mode not in ("r", "rb"):
        raise ValueError("mode: r or rb; write_bytes writes")
    content = read_bytes(path)
    return io.BytesIO(content) if mode == "rb" else io.StringIO(content.decode())
