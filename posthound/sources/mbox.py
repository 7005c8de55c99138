"""Mailboxes as a streaming source: `spark.readStream.format("mbox").option("path", folder)` over growing files of mails.

A connector lists what is new since an offset, reads ranges of it in tasks, and moves its offset only after the rows are written:
offsets are bytes of each file up to its last whole mail, Spark records a batch's offsets before it runs, and again once it is
committed. A batch that died in between is read once more from the same bytes, so that a sink that knows the rows' keys keeps
each mail once. A mail begins with a line `From ` and ends before the next one, or at a file's end if `closed` is true.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "mailbox string, remote_id string, start long, raw binary"
#: Bytes of a file that one task reads, and that are held to look for the last whole mail.
PIECE = 8_000_000


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


def _mails(path: str, r: Range) -> Iterator[tuple]:
    """The mails that begin in a range: a task reads on to the end of its last one."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{root.rstrip('/')}/{r.file}") as f:
        size = f.size()
        at, held = r.start, b""
        base = r.start  # the byte where held begins

        def fill() -> bool:
            nonlocal held, at
            if at >= size:
                return False
            f.seek(at)
            new = f.read(min(PIECE, size - at))
            held, at = held + new, at + len(new)
            return bool(new)

        while True:
            cut = held.find(b"\nFrom ", 1)
            if cut < 0 and fill():
                continue
            whole = held if cut < 0 else held[: cut + 1]
            if not whole or base >= r.end:
                return
            _, _, body = whole.partition(b"\n")
            yield (r.file, f"{r.file}:{base}", base, body.replace(b"\n>From ", b"\nFrom "))
            base, held = base + len(whole), held[len(whole) :]
            if base >= r.end:
                return


def _starts(f, start: int, size: int) -> Iterator[int]:
    """Bytes at which mails begin, from a known beginning on."""
    tail, at = b"\n" if start == 0 else b"", start
    offset = at - len(tail)
    f.seek(at)
    while at < size:
        new = f.read(min(PIECE, size - at))
        if not new:
            return
        data, at = tail + new, at + len(new)
        k = data.find(b"\nFrom ")
        while k >= 0:
            yield offset + k + 1
            k = data.find(b"\nFrom ", k + 1)
        tail = data[-5:]
        offset += len(data) - len(tail)


class Folder:
    """The mailboxes of a folder, as ranges of bytes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.closed = options.get("closed", "false").lower() == "true"
        self.seen: dict[str, int] = {}  # where the last look ended: saves reading, changes no answer

    def _files(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=False))
        return system, {i.base_name: i for i in found if i.type == fs.FileType.File and i.base_name.endswith(".mbox")}

    def whole(self) -> dict[str, int]:
        """Each file up to its last whole mail."""
        system, files = self._files()
        for name, info in sorted(files.items()):
            start = self.seen.get(name, 0)
            if info.size <= start:
                continue
            with system.open_input_file(info.path) as f:
                self.seen[name] = info.size if self.closed else max(_starts(f, start, info.size), default=start)
        return dict(self.seen)

    def ranges(self, before: dict[str, int], upto: dict[str, int] | None = None) -> list[InputPartition]:
        """Ranges of about PIECE bytes, each beginning with a mail, between two looks."""
        system, files = self._files()
        upto = {n: i.size for n, i in files.items()} if upto is None else upto
        out = []
        for name, last in sorted(upto.items()):
            first = before.get(name, 0)
            if name not in files or last <= first:
                continue
            with system.open_input_file(files[name].path) as f:
                cut = first
                for s in _starts(f, first, last):
                    if s - cut >= PIECE:
                        out.append(Range(name, cut, s))
                        cut = s
                out.append(Range(name, cut, last))
        return out

class MboxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)

    def partitions(self) -> list[InputPartition]:
        return self.folder.ranges({})

    def read(self, partition: Range) -> Iterator[tuple]:
        return _mails(self.folder.path, partition)


class MboxStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps(self.folder.whole(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.folder.ranges(json.loads(start["files"]), json.loads(end["files"]))

    def read(self, partition: Range) -> Iterator[tuple]:
        return _mails(self.folder.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing to release: the files are not ours."""


class Mbox(DataSource):
    """Options: path (a folder that all executors see), closed (a file's last mail is whole)."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MboxReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return MboxStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mbox)
