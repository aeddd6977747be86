"""A folder as a stream of changes: what is new, written anew, or gone since the last look.

Spark's own file stream sees a path once, so an edited or deleted file would pass unseen. Here an offset is the listing of
the folder (path, time, size), and events are the difference of two listings, so that a restart repeats the same events.
The listing is the driver's, as the tree that one watches is a working tree; file systems are those that pyarrow knows.
"""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SKIPPED = ("target", "node_modules")
Listing = dict[str, list[int]]


def listing(root: str) -> Listing:
    """path (below the root) to time and size of each file that counts."""
    system, inside = pyarrow.fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))
    out, folders = {}, [inside]
    while folders:  # folders that do not count are not entered
        for info in system.get_file_info(pyarrow.fs.FileSelector(folders.pop(), allow_not_found=True)):
            if info.base_name.startswith(".") or info.base_name in SKIPPED:
                continue
            if info.type == pyarrow.fs.FileType.Directory:
                folders.append(info.path)
            else:
                out[info.path[len(inside) :].lstrip("/")] = [info.mtime_ns or 0, info.size or 0]
    return out


def changes(before: Listing, after: Listing) -> list[tuple[str, str, int]]:
    """(path, change, time) by path: added, modified or removed; what is gone has the latest time that is known."""
    latest = max((t for t, _ in after.values()), default=0)
    out = [(p, "added" if p not in before else "modified", after[p][0]) for p in after if before.get(p) != after[p]]
    return sorted(out + [(p, "removed", max(latest, before[p][0])) for p in before if p not in after])


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"files": listing(self.root)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"files": listing(self.root)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        moment = lambda ns: datetime.datetime.fromtimestamp(ns / 1e9, datetime.timezone.utc)
        return iter([(moment(ns), path, change) for path, change, ns in changes(start["files"], end["files"])])

    def commit(self, end: dict) -> None:
        pass


class FolderChanges(DataSource):
    """spark.readStream.format("folder_changes").option("path", root)"""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "ts timestamp, path string, change string"

    def simpleStreamReader(self, schema) -> Reader:
        return Reader(self.options["path"])
