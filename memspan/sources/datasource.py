"""Sequence files as a data source: ``spark.read.format("sequences").load(path)``, also as a stream.

Columns are file, at (the byte at which the record begins, so records are ordered by file and at), name, chars and size.
Options: ``acgt_only`` and ``split_bytes``. Files are read in ranges of bytes; a record belongs to the range it begins in.
Conditions on name (contains, begins or ends with, equals) and on size (at least, more than, equals) are pushed into the reader, if the
session allows that (``spark.sql.python.filterPushdown.enabled``): bodies of records with other names are skipped over, not made into
strings. A stream takes in files as they come, by the times of their last changes.

Files are opened by Arrow's file systems, so paths may be local ones or of any store that those know; for other stores there is
:func:`memspan.sources.fasta.read_fasta`, which reads by Spark alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, StringContains, StringEndsWith, StringStartsWith

#: Bytes of a range, and of one read.
SPLIT_BYTES, READ_BYTES = 64_000_000, 4_000_000
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_OTHERS = bytes(b for b in range(256) if b not in _LETTERS)
_TO_DNA = bytes(ord(chr(b).upper()) if chr(b) in "ACGTacgt" else 78 for b in range(256))


@dataclass
class Range(InputPartition):
    """Bytes of a file."""

    path: str
    begin: int
    end: int


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of the last change in nanoseconds) of a file or of the files in a folder, by name."""
    from pyarrow import fs

    store, inside = _store(path)
    head = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    found = [(head + i.path, i.size, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    return sorted(found)


def _ranges(files: Iterable[tuple[str, int, int]], split_bytes: int) -> list[Range]:
    return [Range(path, a, min(a + split_bytes, size)) for path, size, _ in files for a in range(0, size, split_bytes)]


def _records(part: Range) -> Iterator[tuple[int, bytes, Callable[[], bytes]]]:
    """(byte, header, function that reads the body) of the records that begin in a range. A body that is not asked for is
    passed over in pieces and never held whole."""
    store, inside = _store(part.path)
    with store.open_input_file(inside) as f:
        if f.read(1) != b">":
            return  # no sequence file
        f.seek(part.begin)
        held, at = f.read(READ_BYTES), part.begin

        def more() -> bool:
            nonlocal held
            new = f.read(READ_BYTES)
            held += new
            return bool(new)

        def skip(n: int) -> None:
            nonlocal held, at
            held, at = held[n:], at + n

        def to_next() -> None:
            """Goes on to the next ``>``, or to the end."""
            while (n := held.find(b">")) < 0:
                skip(len(held))
                if not more():
                    return
            skip(n)

        to_next()
        while held and at < part.end:
            begin = at
            skip(1)
            while (ends := [n for c in (b"\n", b"\r", b">") if (n := held.find(c)) >= 0]) == [] and more():
                pass
            n = min(ends, default=len(held))
            header = held[:n]
            skip(n)

            def body() -> bytes:
                parts = []
                while (n := held.find(b">")) < 0:
                    parts.append(held)
                    skip(len(held))
                    if not more():
                        return b"".join(parts)
                parts.append(held[:n])
                skip(n)
                return b"".join(parts)

            yield begin, header, body
            to_next()


def _condition(f: Filter) -> Callable[[str, int | None], bool] | None:
    """A filter as a function of name and size (none: not known yet), if it is one of those that can be pushed."""
    column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
    value = getattr(f, "value", None)
    if column == "name" and isinstance(value, str):
        by_name = {StringContains: lambda n: value in n, StringStartsWith: lambda n: n.startswith(value), StringEndsWith: lambda n: n.endswith(value), EqualTo: lambda n: n == value}
        test = by_name.get(type(f))
        return test and (lambda name, size: test(name))
    if column == "size" and isinstance(value, int):
        by_size = {GreaterThanOrEqual: lambda n: n >= value, GreaterThan: lambda n: n > value, EqualTo: lambda n: n == value}
        test = by_size.get(type(f))
        return test and (lambda name, size: size is None or test(size))
    return None


class _Options:
    """What both readers do."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.acgt_only = str(options.get("acgt_only", "false")).lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.conditions: list[Filter] = []

    def rows(self, part: Range) -> Iterator[tuple]:
        tests = [_condition(f) for f in self.conditions]
        dropped = _OTHERS + (bytes(b for b in _LETTERS if chr(b) not in "ACGTacgt") if self.acgt_only else b"")
        for at, header, body in _records(part):
            name = header.decode(errors="replace")
            if not all(t(name, None) for t in tests):
                continue
            chars = body().translate(_TO_DNA, dropped).decode()
            if chars and all(t(name, len(chars)) for t in tests):
                yield part.path, at, name, chars, len(chars)


class SequenceReader(_Options, DataSourceReader):
    """Reads files at one time."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _condition(f):
                self.conditions.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        return _ranges(_files(self.path), self.split_bytes)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition)


class SequenceStream(_Options, DataSourceStreamReader):
    """Reads files as they come."""

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((t for *_, t in _files(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges((x for x in _files(self.path) if start["changed"] < x[2] <= end["changed"]), self.split_bytes)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition)


class SequenceSource(DataSource):
    """The format's name, columns and readers."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "file string, at long, name string, chars string, size long"

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(dict(self.options))

    def streamReader(self, schema) -> SequenceStream:
        return SequenceStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SequenceSource)
