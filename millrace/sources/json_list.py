"""A JSON list in one file, read by many tasks.

Spark splits a file into ranges of bytes; within each, this reads the text between closing braces, in order. What a range means depends on what stands before it: whether a text is open there, and how deep brackets
are. So each range is first read under both assumptions, with no text open and with one; both give where it ends and how much deeper it goes. These pairs compose, so going over them once, range by range, says how each really
begins. Then every task cuts its ranges at the commas of the list, and only the two ends of a range have to be put together with those of its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, owning, written

#: A text, to its end or that of what is read; or a bracket, or a comma.
_MARK = re.compile(r'"(?:[^"\\]++|\\.)*+("|\Z)|[\[\]{},]', re.S)
#: The rest of an open text.
_REST = re.compile(r'(?:[^"\\]++|\\.)*+("|\Z)', re.S)
_BLANK = " \t\r\n"
#: What a row of cut text is: an item of the list, the end of one that begins in an earlier range, the beginning of one that ends in a later range, or a part between.
ITEM, END, BEGINNING, MIDDLE = range(4)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start of the range, text up to a closing brace), the rows of a range one after the other."""
    rows = spark.read.text(path, lineSep="}")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """Texts of ranges, in order; a range may be given in parts. A closing brace follows all of them, the last of a file perhaps only here: what follows the list is not looked at closely."""
    for batch in batches:
        files, starts, values = (batch.column(i) for i in range(3))
        low = 0
        for at in range(1, batch.num_rows + 1):
            if at == batch.num_rows or starts[at] != starts[low] or files[at] != files[low]:
                yield (files[low].as_py(), starts[low].as_py()), "}".join(values.slice(low, at - low).to_pylist()) + "}"
                low = at


def read_on(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a text is open at the end of ``text``, if one is at its beginning or not, and how much deeper brackets are there."""
    at = depth = 0
    if inside:
        rest = _REST.match(text)
        if not rest.group(1):
            return True, 0
        at = rest.end()
    inside = False
    for mark in _MARK.finditer(text, at):
        c = text[mark.start()]
        if c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == '"':
            inside = not mark.group(1)
    return inside, depth


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list] = {}
    for key, text in _ranges(batches):
        now = found.setdefault(key, [text.lstrip(_BLANK + "﻿")[:1], False, 0, True, 0])
        now[0] = now[0] or text.lstrip(_BLANK)[:1]
        for k in (1, 3):
            now[k], deeper = read_on(text, now[k])
            now[k + 1] += deeper
    yield pa.RecordBatch.from_pylist([{"file": f, "start": s, "first": v[0], "open0": v[1], "deeper0": v[2], "open1": v[3], "deeper1": v[4]} for (f, s), v in found.items()], schema=_SUMS)


_SUMS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("first", pa.string()), ("open0", pa.bool_()), ("deeper0", pa.int64()), ("open1", pa.bool_()), ("deeper1", pa.int64())])
_CUTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("last", pa.bool_()), ("text", pa.string())])


class Cutter:
    """Cuts a range, which begins within a text or not at a depth, into rows (n, kind, whether the list ends with it, text)."""

    def __init__(self, inside: bool, depth: int) -> None:
        self.inside, self.depth = inside, depth
        self.n, self.held, self.begun = 0, [], depth == 0
        self.ended = False

    def _row(self, last: bool) -> tuple:
        text = "".join(self.held)
        self.held = []
        if not self.begun:
            self.begun = True
            return 0, END, last, text  # blanks may belong to a text that is open across ranges
        self.n += 1
        return self.n, ITEM, last, text.strip(_BLANK)

    def cut(self, text: str) -> Iterator[tuple]:
        at = last = 0
        if self.inside:
            rest = _REST.match(text)
            at = rest.end()
            self.inside = not rest.group(1)
        for mark in _MARK.finditer(text, at) if not self.inside else ():
            place = mark.start()
            c = text[place]
            if c == '"':
                self.inside = not mark.group(1)
            elif c in "[{":
                if self.depth == 0:
                    if self.ended or c == "{" or text[last:place].strip(_BLANK + "﻿"):
                        raise ValueError("a JSON list is expected")
                    last = place + 1
                self.depth += 1
            elif c in "]}":
                if self.depth == 0:
                    break  # the brace that was put behind the last text
                self.depth -= 1
                if self.depth == 0:
                    self.held.append(text[last:place])
                    last, self.ended = place + 1, True
                    row = self._row(True)
                    if row[1] == END or row[3]:
                        yield row
            elif self.depth == 1:
                self.held.append(text[last:place])
                last = place + 1
                yield self._row(False)
        if self.depth:
            self.held.append(text[last:])
        elif self.ended and text[last:].strip(_BLANK + "}"):
            raise ValueError("text follows the list")

    def rest(self) -> Iterator[tuple]:
        text = "".join(self.held)
        if self.depth:
            yield (self.n + 1, BEGINNING, False, text) if self.begun else (0, MIDDLE, False, text)


def _cut(starts: dict[tuple[str, int], tuple[bool, int]]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter = None, None
        table = lambda rows: pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "n": n, "kind": k, "last": last, "text": t} for n, k, last, t in rows], schema=_CUTS)
        for key, text in _ranges(batches):
            if key != now:
                if cutter is not None:
                    yield table(cutter.rest())
                now, cutter = key, Cutter(*starts[key])
            yield table(cutter.cut(text))
        if cutter is not None:
            yield table(cutter.rest())

    return cut


def begins(sums: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """How each range begins, from what all of them do. Raises ValueError if a file is no list or does not end."""
    out: dict[tuple[str, int], tuple[bool, int]] = {}
    file, inside, depth, first = None, False, 0, ""
    # A brace that the file does not have follows its last text, which is at least the bracket that ends the list, so a list that ends has a depth of -1 behind it.
    for row in [*sorted(sums, key=lambda r: (r["file"], r["start"])), None]:
        if row is None or row["file"] != file:
            if file is not None and (inside or depth != -1):
                raise ValueError("the JSON list does not end")
            if row is None:
                break
            file, inside, depth, first = row["file"], False, 0, ""
        if not first:
            first = row["first"]
            if first and first != "[":
                raise ValueError("a JSON list is expected")
        out[row["file"], row["start"]] = (inside, depth)
        inside, deeper = (row["open1"], row["deeper1"]) if inside else (row["open0"], row["deeper0"])
        depth += deeper
    return out


def items(spark: SparkSession, path: str) -> DataFrame:
    """(index, text) of the items of the JSON list at ``path``, in order; of several files one after the other by path.

    Raises ValueError if a file holds no list, ends before its list does, or goes on behind it. Items are as they are written; whether each is JSON shows where it is parsed. The driver sees five values of
    each range of a file, of which there are as many as Spark makes splits.
    """
    pieces = _pieces(spark, path)
    sums = pieces.mapInArrow(_summed, "file string, start long, first string, open0 boolean, deeper0 long, open1 boolean, deeper1 long").collect()
    if not any(row["first"] for row in sums):
        raise ValueError("a JSON list is expected")
    cuts = written(pieces.mapInArrow(_cut(begins(sums)), "file string, start long, n long, kind int, last boolean, text string"), "json-items")
    ends = cuts.where(F.col("kind") != ITEM)
    # An item of several ranges goes from a beginning to the next end; its number is that of its beginning.
    order = Window.partitionBy("file").orderBy("start", "n")
    runs = ends.select("file", "start", "n", "kind").withColumn("run", F.last(F.when(F.col("kind") == BEGINNING, F.struct("start", "n")), ignorenulls=True).over(order))
    texts = ends.join(runs.select("file", "start", "n", "run"), ["file", "start", "n"])
    joined = texts.groupBy("file", "run").agg(F.array_sort(F.collect_list(F.struct("start", "n", "text"))).alias("parts"), F.max("last").alias("last"))
    joined = joined.select("file", F.col("run.start").alias("start"), F.col("run.n").alias("n"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), "last")
    # A comma ends an item even if nothing stands before it, which is no JSON and shows as such; the end of the list does not.
    joined = joined.where(~F.col("last") | (F.trim(F.translate("text", "\t\r\n", "   ")) != ""))
    whole = cuts.where(F.col("kind") == ITEM).select("file", "start", "n", "text").unionByName(joined.drop("last"))
    rows = written(whole, "json-list")
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("rows"))
    before = counts.select("file", "start", (F.sum("rows").over(Window.orderBy("file", "start")) - F.col("rows")).alias("before"))
    discard(cuts)
    return owning(rows.join(F.broadcast(before), ["file", "start"]).select((F.col("before") + F.col("n") - 1).alias("index"), "text"), rows)
