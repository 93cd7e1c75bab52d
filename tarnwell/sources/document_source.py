"""Folders of documents as a data source: ``spark.read.format("documents").load(folder)``.

The driver lists files; a partition is some files of about PACK bytes together, which its
task opens, so texts are read where they are parsed. Filters on suffix, path and bytes
are pushed down, if the session allows it (FILTERS), and files that they rule out are
never opened. Lines of .jsonl files are documents of their own, and large ones are read
in ranges of bytes: a range has the lines that begin in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from tarnwell.sources.stores import store
from tarnwell.sources.tables import DOCUMENTS, parsed_text

FILTERS = "spark.sql.python.filterPushdown.enabled"
#: Bytes of a partition, and of what is read at once of a file of lines.
PACK, READ = 32 << 20, 1 << 20
LINES = ".jsonl"
SCHEMA = "path string, suffix string, bytes long, line long, text string, error string"


@dataclass(frozen=True)
class Part:
    """A file, or the lines that begin in a range of one; ends at -1 is the whole file."""

    path: str
    size: int
    start: int = 0
    end: int = -1

    @property
    def suffix(self) -> str:
        name = self.path.rpartition("/")[2]
        return "." + name.rpartition(".")[2].lower() if "." in name else ""


@dataclass
class Pack(InputPartition):
    parts: tuple[Part, ...]


class DocumentReader(DataSourceReader):
    def __init__(self, folder: str, pack: int) -> None:
        self.folder, self.pack, self.rules = folder, pack, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        compare = {EqualTo: lambda x, y: x == y, In: lambda x, y: x in y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, StringStartsWith: lambda x, y: x.startswith(y)}
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in compare and column in ("suffix", "path", "bytes"):
                self.rules.append((column, compare[type(f)], f.value))
            else:
                yield f

    def _wanted(self, part: Part) -> bool:
        of = {"suffix": part.suffix, "path": part.path, "bytes": part.size}
        return all(test(of[column], value) for column, test, value in self.rules)

    def partitions(self) -> Sequence[Pack]:
        fs, root = store(self.folder)
        listed = fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        files = [Part(f.path, f.size) for f in sorted(listed, key=lambda f: f.path) if f.type == pa.fs.FileType.File]
        packs: list[list[Part]] = []
        held = self.pack
        for part in (p for p in files if p.suffix in (*DOCUMENTS, LINES) and self._wanted(p)):
            if part.suffix == LINES and part.size > self.pack:
                packs += [[Part(part.path, part.size, at, min(part.size, at + self.pack))] for at in range(0, part.size, self.pack)]
                held = self.pack
                continue
            if held + part.size > self.pack:
                packs.append([])
                held = 0
            packs[-1].append(part)
            held += part.size
        return [Pack(tuple(p)) for p in packs]

    def read(self, partition: Pack) -> Iterator[tuple]:
        fs, _ = store(self.folder)
        for part in partition.parts:
            if part.suffix == LINES:
                for at, line in _lines(fs, part):
                    yield part.path, part.suffix, part.size, at, line.decode("utf-8", "replace"), None
                continue
            with fs.open_input_stream(part.path) as file:
                content = file.read()
            text, error = _text(part.suffix, content)
            yield part.path, part.suffix, part.size, None, text, error


def _text(suffix: str, content: bytes) -> tuple[str | None, str | None]:
    """A document's text, or why there is none."""
    if suffix in (".md", ".txt"):
        try:
            return content.decode("utf-8-sig"), None
        except UnicodeDecodeError:
            return content.decode("latin-1"), None
    if suffix not in (".docx", ".rtf"):
        return None, f"parser_missing:{suffix[1:]}"
    text = parsed_text(suffix, content)
    return text, None if text is not None else f"parser_failed:{suffix[1:]}"


def _lines(fs: pa.fs.FileSystem, part: Part) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a part's range, empty ones left out; a line may end beyond."""
    end = part.size if part.end < 0 else part.end
    with fs.open_input_file(part.path) as file:
        at = part.start
        if at:  # the line that the byte before belongs to is the range's before
            file.seek(at - 1)
            rest = b""
            while True:
                more = file.read(READ)
                cut = more.find(b"\n")
                if cut >= 0 or not more:
                    rest = more[cut + 1 :] if cut >= 0 else b""
                    at += cut if cut >= 0 else 0
                    break
                at += len(more)
            if not more:
                return
        else:
            rest = b""
        while at < end:
            cut = rest.find(b"\n")
            if cut < 0 and (more := file.read(READ)):
                rest += more
                continue
            line = rest if cut < 0 else rest[:cut]
            if line.strip():
                yield at, line
            if cut < 0:
                return
            at += cut + 1
            rest = rest[cut + 1 :]


class DocumentSource(DataSource):
    """Options: path, the folder; pack, bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DocumentReader:
        return DocumentReader(self.options["path"], int(self.options.get("pack", PACK)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.conf.set(FILTERS, "true")
    spark.dataSource.register(DocumentSource)
