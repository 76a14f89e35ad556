"""Sheets of workbooks (Office Open XML) as typed tables: one task streams the XML of a sheet out of the file."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers of the built-in formats that show dates or times; days are counted from one of two dates.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_EPOCHS = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}
_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampNTZType(), "boolean": T.BooleanType(), "string": T.StringType()}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "timestamp": pa.timestamp("us"), "boolean": pa.bool_(), "string": pa.string()}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements ``tag`` of a part of the file, each emptied when the next is asked for, so that no tree of the part is held."""
    if part not in book.namelist():
        return
    with book.open(part) as source:
        events = ElementTree.iterparse(source, ("start", "end"))
        parents: list[ElementTree.Element] = []
        for event, element in events:
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if _local(element.tag) == tag:
                yield element
                if parents:
                    parents[-1].remove(element)


def _text(item: ElementTree.Element) -> str:
    """Text of a string item: its runs, without phonetic ones."""
    out = []
    for child in item:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def _shows_date(code: str) -> bool:
    """Whether a format code shows a date or time: one of its letters stands outside quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!(?:h+|m+|s+)\])[^\]]*\]', "", code.split(";")[0], flags=re.I)
    return bare.lower() != "general" and bool(re.search(r"[dmyhs]", bare, re.I))


class _Book:
    """Names of sheets, shared strings, and which cell styles are dates."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        targets = {}
        for link in _elements(self.zip, "xl/_rels/workbook.xml.rels", "Relationship"):
            target = link.get("Target", "")
            targets[link.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        self.parts = {s.get("name"): targets.get(_attribute(s, "id")) for s in _elements(self.zip, "xl/workbook.xml", "sheet")}
        said = next(_elements(self.zip, "xl/workbook.xml", "workbookPr"), None)
        self.epoch = _EPOCHS[said is not None and said.get("date1904") in ("1", "true")]
        codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _elements(self.zip, "xl/styles.xml", "numFmt")}
        cells = next(_elements(self.zip, "xl/styles.xml", "cellXfs"), None)
        numbers = [] if cells is None else [int(x.get("numFmtId", 0)) for x in cells]
        self.dates = [_shows_date(codes[n]) if n in codes else n in _DATE_FORMATS for n in numbers]

    def rows(self, sheet: str) -> Iterator[list]:
        """Values of each row that has one."""
        part = self.parts.get(sheet)
        if part is None:
            raise ValueError(f"no sheet {sheet!r}: the workbook has {', '.join(map(repr, self.parts))}")
        shared = [_text(i) for i in _elements(self.zip, "xl/sharedStrings.xml", "si")]
        for row in _elements(self.zip, part, "row"):
            values: list = []
            for cell in row:
                place = cell.get("r")
                at = _column(place) if place else len(values)
                values += [None] * (at + 1 - len(values))
                values[at] = self._value(cell, shared)
            if any(v is not None for v in values):
                yield values

    def _value(self, cell: ElementTree.Element, shared: list[str]):
        kind, said, inline = cell.get("t", "n"), None, None
        for child in cell:
            if _local(child.tag) == "v":
                said = child.text
            elif _local(child.tag) == "is":
                inline = _text(child)
        if kind == "inlineStr":
            return inline or None
        if not said or kind == "e":
            return None
        if kind == "s":
            return shared[int(said)] or None
        if kind == "b":
            return said == "1"
        if kind == "d":
            return datetime.fromisoformat(said.replace("Z", ""))
        if kind == "str":
            return said
        style = int(cell.get("s", 0))
        number = float(said)
        if style < len(self.dates) and self.dates[style]:
            return self.epoch + timedelta(milliseconds=round(number * 86_400_000))
        return int(number) if number.is_integer() and abs(number) < 1 << 53 else number


def _column(place: str) -> int:
    """0 for A1, 26 for AA1."""
    return reduce(lambda n, letter: 26 * n + ord(letter) - 64, (c for c in place.upper() if "A" <= c <= "Z"), 0) - 1


def _kind(value) -> str:
    return {bool: "boolean", int: "long", float: "double", datetime: "timestamp"}.get(type(value), "string")


def _wider(one: str | None, other: str | None) -> str | None:
    """The type that holds values of both."""
    if one is None or other is None or one == other:
        return one or other
    return "double" if {one, other} == {"long", "double"} else "string"


def _names(head: list) -> list[str]:
    """Names of columns: blank ones by their place, repeated ones with a number."""
    out: list[str] = []
    for k, value in enumerate(head):
        name = base = f"column_{k}" if value is None else _as(value, "string")
        n = 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


def _as(value, kind: str):
    if value is None or kind != "string" or isinstance(value, str):
        return float(value) if kind == "double" and value is not None else value
    return value.isoformat(" ") if isinstance(value, datetime) else str(value).lower() if isinstance(value, bool) else str(value)


def columns(spark: SparkSession, path: str, sheet: str) -> dict[str, str]:
    """Names and types of a sheet's columns, from all its rows; the sheet is read where the file is, only this reaches the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = _Book(content.as_py()).rows(sheet)
                names = _names(next(rows, []))
                kinds: list[str | None] = [None] * len(names)
                for row in rows:
                    for k, value in enumerate(row[: len(names)]):
                        if value is not None and kinds[k] != "string":
                            kinds[k] = _wider(kinds[k], _kind(value))
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "kind": pa.array([k or "string" for k in kinds], pa.string())})

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, "name string, kind string")
    out: dict[str, str] = {}
    for row in found.collect():
        out[row["name"]] = _wider(out.get(row["name"]), row["kind"])
    return out


def sheet(spark: SparkSession, path: str, name: str, kinds: dict[str, str] | None = None, batch_rows: int = 8192) -> DataFrame:
    """The rows of the sheet ``name`` of the workbook at ``path`` (several: one below the other), in any file system that Spark reads.

    The first row that has a value names the columns; ``kinds`` gives their types (long, double, timestamp, boolean,
    string), which are found from all rows where it is not given: a column of several types holds texts, dates have no time
    zone, empty cells, empty texts and errors are null. Rows without a value are left out, as are cells beyond the named columns.
    A workbook without the sheet raises an error; a sheet without rows has no columns. A file is one task, as its sheets end after 1,048,576 rows.
    """
    kinds = columns(spark, path, name) if kinds is None else kinds
    schema = T.StructType([T.StructField(c, _TYPES[k]) for c, k in kinds.items()])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: list[list], at: list[int | None]) -> pa.RecordBatch:
            arrays = [pa.array([_as(row[i], k) if i is not None and i < len(row) else None for row in held], _ARROW[k]) for i, k in zip(at, kinds.values())]
            return pa.RecordBatch.from_arrays(arrays, list(kinds))

        for batch in batches:
            for content in batch.column(0):
                rows = _Book(content.as_py()).rows(name)
                names = _names(next(rows, []))
                at = [names.index(c) if c in names else None for c in kinds]
                held: list[list] = []
                for row in rows:
                    held.append(row)
                    if len(held) == batch_rows:
                        yield batch_of(held, at)
                        held = []
                if held:
                    yield batch_of(held, at)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def workbook(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The sheets ``names`` one below the other, each its own task, with ``sheet``: the name of a row's. Columns are matched by name and get the type that holds those of all sheets; a sheet that lacks one has nulls there."""
    if not names:
        raise ValueError("at least one sheet must be named")
    found = [columns(spark, path, name) for name in names]
    kinds: dict[str, str] = {}
    for one in found:
        for column, kind in one.items():
            kinds[column] = _wider(kinds.get(column), kind)
    parts = [sheet(spark, path, name, kinds).withColumn("sheet", F.lit(name)) for name in names]
    return reduce(DataFrame.unionByName, parts)
