"""A splittable source of bibliography dumps: the records of any kinds in one scan, named entities understood.

A dump is one XML element around a flat list of records. Tasks read ranges of bytes; a record belongs to the range that its
start tag begins in, and the task that owns it reads on past the end of its range. So the rows are the same for any
number of ranges, and a task holds one record and one block of the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.entities import html5
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The kinds of records that a dump holds.
KINDS = ("article", "inproceedings", "proceedings", "book", "incollection", "phdthesis", "mastersthesis", "www", "person", "data")
SCHEMA = "kind string, key string, fields array<struct<name:string,type:string,text:string>>"
_FIELD = pa.struct([("name", pa.string()), ("type", pa.string()), ("text", pa.string())])
ARROW = pa.schema([("kind", pa.string()), ("key", pa.string()), ("fields", pa.list_(_FIELD))])
BLOCK, RANGE, ROWS = 1 << 20, 64 << 20, 2_000
TASKS = 4_096  # ranges of a dump, above which they get longer
XML_OWN = {b"amp", b"lt", b"gt", b"quot", b"apos"}


def plain_entities(record: bytes) -> bytes:
    """Named entities as numeric references, which need no document type; XML's own five stay. An unknown one raises."""

    def number(m: re.Match) -> bytes:
        if m[1] in XML_OWN:
            return m[0]
        known = html5.get(m[1].decode() + ";")
        if known is None:
            raise ValueError(f"unknown entity {m[0].decode()}")
        return "".join(f"&#{ord(c)};" for c in known).encode()

    return re.sub(rb"&([A-Za-z][A-Za-z0-9]*);", number, record)


def cut(read: Callable[[int], bytes], start: int, end: float, kinds: tuple[str, ...], block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of each record of the kinds whose start tag begins in start..end; read(n) goes on from start.

    Start tags are told by the name of a record kind, which no field of a record has. Raises where a record does not end.
    """
    opens = re.compile(rb"<(" + b"|".join(k.encode() for k in kinds) + rb")(?=[\s/>])")
    longest = max(map(len, kinds)) + 2
    # held is the file from byte at on; what lies before place has been seen. It is cut only when a block is read, so that
    # a record costs its own bytes, not the block's.
    held, at, place, more = b"", start, 0, True
    while True:
        found = opens.search(held, place)
        if found is None:
            place = max(place, len(held) - longest)
            if not more or at + place >= end:
                return
            piece = read(block)
            more = bool(piece)
            held, at, place = held[place:] + piece, at + place, 0
            continue
        if at + found.start() >= end:
            return
        place = found.start()
        close, seen, size = b"</" + found[1] + b">", place, 0
        while not size:
            head = held.find(b">", place)
            if head >= 0 and held[head - 1 : head] == b"/":
                size = head + 1 - place
                break
            found_at = held.find(close, seen)
            if found_at >= 0:
                size = found_at + len(close) - place
                break
            held, at, seen, place = held[place:], at + place, max(0, len(held) - place - len(close)), 0
            # A record longer than a block reads as much again as it has, so that long ones are not copied over and over.
            piece = read(max(block, len(held)))
            if not piece:
                raise ValueError(f"the record at byte {at} does not end")
            held += piece
        yield at + place, held[place : place + size]
        place += size


def parsed(record: bytes, encoding: str) -> tuple[str, str | None, list[dict]]:
    """(kind, key, fields) of a record; markup inside a field is taken away, its text stays."""
    root = ElementTree.fromstring(b'<?xml version="1.0" encoding="' + encoding.encode() + b'"?>' + plain_entities(record))
    return root.tag, root.get("key"), [{"name": f.tag, "type": f.get("type"), "text": "".join(f.itertext()).strip()} for f in root]


def declared_encoding(head: bytes) -> str:
    """The encoding that the first line declares, UTF-8 without one; only those in which ASCII bytes are ASCII."""
    m = re.match(rb"""(?:\xef\xbb\xbf)?\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)""", head)
    name = m[1].decode().lower() if m else "utf-8"
    if not (name in ("utf-8", "us-ascii", "ascii") or name.startswith(("iso-8859-", "windows-125"))):
        raise ValueError(f"cannot cut a dump in {name}")
    return name


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: float, encoding: str) -> None:
        super().__init__((path, start))
        self.path, self.start, self.end, self.encoding = path, start, end, encoding


class DumpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.range = options["path"], int(options.get("range", RANGE))
        self.kinds = tuple(k.strip() for k in options.get("kinds", ",".join(KINDS)).split(","))

    def _store(self):
        from pyarrow import fs

        uri = self.uri if re.match(r"[a-z][a-z0-9+.-]*:", self.uri) else f"file://{self.uri}"
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))

    def partitions(self) -> list[Range]:
        """A file or a folder of files, each in ranges; a compressed file is one range."""
        from pyarrow import fs

        store, path = self._store()
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        files = sorted((f for f in files if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.size), key=lambda f: f.path)
        size = max(self.range, sum(f.size for f in files) // TASKS)
        for f in files:
            with store.open_input_stream(f.path) as s:
                encoding = declared_encoding(s.read(200))
            packed = f.path.endswith((".gz", ".bz2", ".zst"))
            out += [Range(f.path, 0, float("inf"), encoding)] if packed else [Range(f.path, k, min(k + size, f.size), encoding) for k in range(0, f.size, size)]
        return out or [Range("", 0, 0, "utf-8")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = self._store()
        rows: list = []
        if part.end == float("inf"):
            stream = store.open_input_stream(part.path)
        else:
            stream = store.open_input_file(part.path)
            stream.seek(part.start)
        with stream:
            for at, record in cut(stream.read, part.start, part.end, self.kinds, min(BLOCK, max(1 << 16, self.range))):
                try:
                    kind, key, fields = parsed(record, part.encoding)
                except (ElementTree.ParseError, ValueError) as error:
                    raise ValueError(f"{part.path}, byte {at}: {error}") from error
                rows.append({"kind": kind, "key": key, "fields": fields})
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class Dump(DataSource):
    """Options: path; kinds, separated by commas; range, the bytes of a task (more where a dump would have over TASKS)."""

    @classmethod
    def name(cls) -> str:
        return "bibliography"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DumpReader:
        return DumpReader(self.options)
