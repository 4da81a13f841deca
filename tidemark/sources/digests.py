"""A data source of file digests: name, size and SHA-256 of every file below a path, whatever its size.

    spark.dataSource.register(FileDigests)
    spark.read.format("file_digests").option("pattern", "*.csv").load("/data/raw")

The driver lists the files; partitions are single large files or small ones packed together. A task streams its
files through the hash chunk by chunk, so its memory doesn't depend on their size, and a lost executor costs the files
it was reading. Paths may be local or of any store that Arrow's file systems know (hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_BYTES = 4 << 20
PACK_BYTES = 256 << 20  # small files are read by one task up to this size


def _opened(path: str):
    """The file system of a path or address and the path inside it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Files(InputPartition):
    root: str
    names: list[str]

    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names


class DigestReader(DataSourceReader):
    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, pattern

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, base = _opened(self.root)
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((f for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        parts, room = [], 0
        for f in files:
            if not parts or f.size > room:
                parts.append(Files(self.root, []))
                room = PACK_BYTES
            parts[-1].names.append(f.path)
            room -= f.size
        return parts

    def read(self, partition: Files) -> Iterator[tuple]:
        system, base = _opened(partition.root)
        for name in partition.names:
            digest, n = hashlib.sha256(), 0
            with system.open_input_stream(name, buffer_size=0) as held:
                while chunk := held.read(CHUNK_BYTES):
                    digest.update(chunk)
                    n += len(chunk)
            yield name.removeprefix(base).lstrip("/") or name.rsplit("/", 1)[-1], n, digest.hexdigest()


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "file string, bytes long, sha256 string"

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options["path"], self.options.get("pattern", "*"))
