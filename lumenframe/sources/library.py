"""A Python data source that lists a library: ``spark.read.format("media_library").load(root)``, or ``readStream``.

Spark's file sources drop names that begin with an underscore and can't prune bundle folders before they descend.
This source lists folders itself: hidden folders and bundles are pruned, and filters on ``ext`` are applied before a
file is opened for its first bytes.

Partitions: from the root on, folders are opened in turn, widest level first, until ``splits`` folders wait below the opened
ones, or none is left; each of these is a partition with all that lies below it.  Of the opened folders there remain the
files that lie in them, dealt in parts of ``files`` by hash of their names, so one deep or one huge folder is split, too.

As a stream it gives the files whose content, or place, has changed since the batch before: offsets are moments, and
``settle`` seconds (2) are left for clocks that differ.  What changes again meanwhile comes with the next batch; files
that are gone are not told.

Options: ``links`` (false: no symbolic links), ``head`` (21: bytes to read of each file, 0 for none), ``splits`` (256), ``files`` (20,000), ``settle``.
"""

from __future__ import annotations

import os
import time
from collections import deque
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .. import schemas, values


class Folder(InputPartition):
    """A folder with all below it (``deep``), or part ``part`` of ``parts`` of the files in it; those changed in a span of time, if ``span`` is given."""

    def __init__(self, path: str, deep: bool, part: int = 0, parts: int = 1, span: tuple[int, int] | None = None):
        super().__init__(path)
        self.path, self.deep, self.part, self.parts, self.span = path, deep, part, parts, span


class Listing:
    """What the reader of a table and that of a stream share."""

    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.links = options.get("links", "false").lower() == "true"
        self.head = int(options.get("head", "21"))
        self.splits = max(1, int(options.get("splits", "256")))
        self.files = max(1, int(options.get("files", "20000")))
        self.settle = float(options.get("settle", "2"))
        self.wanted: set[str] | None = None

    def dealt(self, span: tuple[int, int] | None = None) -> list[Folder]:
        waiting, out = deque([""]), []
        while waiting and len(waiting) < self.splits and len(out) < 4 * self.splits:
            at, files = waiting.popleft(), 0
            try:
                with os.scandir(os.path.join(self.root, at)) as entries:
                    for e in entries:
                        if not e.is_dir(follow_symlinks=False):
                            files += 1
                        elif visible(e.name):
                            waiting.append(f"{at}/{e.name}" if at else e.name)
            except OSError:
                if not at:
                    raise
                continue
            parts = -(-files // self.files)
            out.extend(Folder(at, False, k, parts, span) for k in range(parts))
        return [*out, *(Folder(at, True, span=span) for at in sorted(waiting))] or [Folder("", False, span=span)]

    def listed(self, partition: Folder) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            at = todo.pop()
            folders = []
            try:
                entries = os.scandir(os.path.join(self.root, at))
            except OSError:  # gone meanwhile, or closed to us
                continue
            with entries:
                for e in sorted(entries, key=lambda e: e.name):
                    path = f"{at}/{e.name}" if at else e.name
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep and visible(e.name):
                            folders.append(path)
                    elif not e.name.startswith(".") and (self.links or not e.is_symlink()):
                        if partition.parts > 1 and crc32(os.fsencode(e.name)) % partition.parts != partition.part:
                            continue
                        row = self.row(path, at, e, partition.span)
                        if row:
                            yield row
            todo.extend(reversed(folders))

    def row(self, path: str, at: str, e: os.DirEntry, span: tuple[int, int] | None = None) -> tuple | None:
        stem, suffix = os.path.splitext(e.name)
        ext = suffix.lower()
        if self.wanted is not None and ext not in self.wanted:
            return None
        try:
            st = e.stat(follow_symlinks=False)
            if span is not None and not span[0] < max(st.st_mtime_ns, st.st_ctime_ns) <= span[1]:
                return None
            head = b""
            if self.head and e.is_file():
                with open(os.path.join(self.root, path), "rb") as f:
                    head = f.read(self.head)
        except OSError:
            return None
        born = getattr(st, "st_birthtime", None)  # only some systems tell
        return (path, at, e.name, stem, suffix, ext, e.is_symlink(), st.st_size, st.st_mtime_ns, st.st_ctime_ns, st.st_ino, st.st_dev, st.st_nlink, head, born)


class LibraryReader(Listing, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ext",):
                self.wanted = {f.value} if self.wanted is None else self.wanted & {f.value}
            elif isinstance(f, In) and f.attribute == ("ext",):
                self.wanted = set(f.value) if self.wanted is None else self.wanted & set(f.value)
            else:
                yield f

    def partitions(self) -> list[Folder]:
        return self.dealt()

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.listed(partition)


class LibraryStream(Listing, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"ns": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"ns": time.time_ns() - int(self.settle * 1_000_000_000)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.dealt((start["ns"], end["ns"]))

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.listed(partition)


def visible(folder: str) -> bool:
    return not folder.startswith(".") and os.path.splitext(folder)[1].lower() not in values.BUNDLE


class Library(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_library"

    def schema(self) -> str:
        return schemas.FILE

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(self.options)

    def streamReader(self, schema) -> LibraryStream:  # noqa: N802
        return LibraryStream(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Library)
