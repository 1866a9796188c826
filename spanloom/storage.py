"""Small files through Hadoop's file systems: listing, heads and tails, and documents that are written once."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Any, NamedTuple

from pyspark.sql import SparkSession

from spanloom.errors import SourceError

AT_ONCE = 16


class File(NamedTuple):
    path: str
    modified: int
    size: int


class Storage:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def files(self, path: str, suffixes: tuple[str, ...] = ()) -> list[File]:
        """The files that ``path`` (a file, a folder, or a pattern) names, below folders too. None at all is an error."""
        fs, out = self._fs(path), []
        found = fs.globStatus(self._path(path)) or []
        todo = list(found)
        if not todo:
            raise SourceError(f"nothing at {path} that the driver can see")
        while todo:
            status = todo.pop()
            name = status.getPath().getName()
            if status.isDirectory():
                todo += [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
            elif not suffixes or name.endswith(suffixes):
                out.append(File(status.getPath().toString(), status.getModificationTime(), status.getLen()))
        return sorted(out)

    def part(self, file: File, at: int, n: int) -> bytes:
        """At most ``n`` bytes from position ``at``."""
        stream = self._fs(file.path).open(self._path(file.path))
        try:
            stream.seek(at)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
        finally:
            stream.close()

    def first_line(self, file: File, n: int = 1 << 16) -> bytes:
        """The first line that isn't blank, as far as ``n`` bytes go."""
        return self.part(file, 0, n).lstrip().split(b"\n", 1)[0]

    def torn_line(self, file: File, n: int = 1 << 20) -> str | None:
        """What follows the file's last line break; None if nothing does."""
        end = self.part(file, max(0, file.size - n), n)
        left = end.rsplit(b"\n", 1)[-1]
        return left.decode("utf-8", "replace").strip() or None

    def each(self, fn, files: list[File]) -> list:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(fn, files))

    def put(self, path: str, value: Any) -> None:
        """Write a JSON document under a name that nothing has yet: whole, or not at all."""
        fs, fresh = self._fs(path), f"{path}.{uuid.uuid4().hex}.tmp"
        out = fs.create(self._path(fresh))
        out.write(bytearray(json.dumps(value, default=str).encode()))
        out.close()
        if fs.exists(self._path(path)) or not fs.rename(self._path(fresh), self._path(path)):
            fs.delete(self._path(fresh), False)
            raise SourceError(f"{path} exists: another writer was faster")

    def get(self, path: str) -> Any:
        status = self._fs(path).getFileStatus(self._path(path))
        return json.loads(self.part(File(path, 0, status.getLen()), 0, status.getLen()))

    def numbered(self, folder: str, name: str) -> list[tuple[int, str]]:
        """(number, path) of the documents ``name-<number>.json`` of a folder, in order."""
        fs = self._fs(folder)
        if not fs.exists(self._path(folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(folder))]
        mine = [n for n in names if n.startswith(f"{name}-") and n.endswith(".json")]
        return sorted((int(n[len(name) + 1 : -5]), f"{folder}/{n}") for n in mine)

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)


class Documents:
    """Numbered versions of JSON documents in a folder. The newest counts; a version is never changed, and there is a
    whole one at every moment."""

    def __init__(self, storage: Storage, folder: str, keep: int = 5):
        self.storage, self.folder, self.keep = storage, folder, keep

    def read(self, name: str, default: Any) -> Any:
        found = self.storage.numbered(self.folder, name)
        return self.storage.get(found[-1][1]) if found else default

    def write(self, name: str, value: Any) -> None:
        found = self.storage.numbered(self.folder, name)
        self.storage.put(f"{self.folder}/{name}-{(found[-1][0] if found else 0) + 1:09d}.json", value)
        for _, path in found[: -self.keep]:
            self.storage.delete(path)
