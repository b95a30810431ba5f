"""Small files beside a log: a counter, and markers that hold their content in their names.

A file is made whole or not at all, and by one writer only, on every file system with atomic creation.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, MutableMapping
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """The names in a folder, through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._of(f"{self.path}/{name}" if name else self.path))

    def names(self) -> list[str]:
        """Sorted; none if there is no such folder."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._of(self.path))) if self.exists() else []

    def folders(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._of(self.path)) if x.isDirectory()) if self.exists() else []

    def make(self, name: str) -> bool:
        """Makes an empty file; false if it is there already."""
        path = self._of(f"{self.path}/{name}")
        if self._fs.getScheme() == "file":  # Spark's local file system looks first and creates then
            local = path.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(path, False).close()
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        return True

    def drop(self, name: str = "") -> None:
        self._fs.delete(self._of(f"{self.path}/{name}" if name else self.path), True)

    def bytes(self) -> tuple[int, int]:
        """(files, bytes) below it."""
        if not self.exists():
            return 0, 0
        found = self._fs.getContentSummary(self._of(self.path))
        return found.getFileCount(), found.getLength()


class Counter:
    """Numbers that rise and are given once each, whoever asks.

    A number's marker can be made by one writer only, and the greatest is never dropped: so a number whose marker was
    dropped is always below one that is there, and who makes it once more sees that and takes another.
    """

    def __init__(self, folder: Folder):
        self.folder = folder

    def last(self) -> int:
        return max(self._numbers(), default=0)

    def _numbers(self) -> list[int]:
        return [int(n) for n in self.folder.names() if n.isdigit()]

    def take(self, least: int = 0) -> int:
        """The next number, and at least ``least``."""
        while True:
            n = max(max(self._numbers(), default=-1) + 1, least)
            while not self.folder.make(f"{n:019d}"):
                n += 1
            there = self._numbers()
            if max(there) > n:  # else it may have been given and its marker dropped since the look at them
                continue
            for other in there:
                if other < n:
                    self.folder.drop(f"{other:019d}")
            return n


class Markers(MutableMapping):
    """Texts with a value each, kept as names of files: sessions to come see them."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def _all(self) -> dict[str, str]:
        return {unquote(k): unquote(v) for k, _, v in (n.partition("=") for n in self.folder.names() if "=" in n)}

    def __getitem__(self, key: str) -> str:
        return self._all()[key]

    def __setitem__(self, key: str, value) -> None:
        old = self._all().get(key)
        if old != str(value):
            self.folder.make(f"{quote(key, safe='')}={quote(str(value), safe='')}")
            if old is not None:
                self.folder.drop(f"{quote(key, safe='')}={quote(old, safe='')}")

    def __delitem__(self, key: str) -> None:
        self.folder.drop(f"{quote(key, safe='')}={quote(self._all()[key], safe='')}")

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._all()))

    def __len__(self) -> int:
        return len(self._all())


class Numbers(Markers):
    """Markers whose values are integers."""

    def __getitem__(self, key: str) -> int:
        return int(super().__getitem__(key))
