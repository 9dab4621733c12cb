"""CSV files with quoted line breaks, read by many tasks each.

Spark splits a text file into ranges of lines, but a range does not know whether its first line begins inside a quoted
field. Every line is a function from "begins inside quotes" to "ends inside quotes", found by two patterns on the line
alone. A first pass composes these functions over each range and keeps, for either beginning, the lines before the
first record's start and those of the record left open at the end. The ranges' beginnings follow from the functions of
the ranges before them, one small row a range. A second pass then cuts every range into whole records; records that
cross a border are put together from what the first pass kept. `from_csv` parses the records.

Line ends are `\\n` or `\\r\\n`. The dialect is that of `snapshot`: commas, `"` quotes, `\\` escapes inside quotes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A closed quoted field (text after its closing quote belongs to it), or one that does not begin with a quote.
_INSIDE = r'[^"\\]*+(?:\\["\\]?+[^"\\]*+)*+'
_FIELD = rf'(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|)'
_CLOSED = rf"^{_FIELD}(?:,{_FIELD})*+\z"
_CLOSES = rf'^{_INSIDE}"[^,]*+(?:,{_FIELD})*+\z'

LINE = "file string, block bigint, line string, after_out boolean, after_in boolean"
RANGE = (
    "file string, block bigint, out_ends boolean, in_ends boolean, out_tail string, in_head string, in_tail string, "
    "in_closes boolean, first_open boolean, windows boolean"
)
PIECE = "file string, owner bigint, block bigint, at int, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its range and the state after it, for a beginning outside and inside quotes."""
    line = F.col("value")
    bare = F.regexp_replace(line, r"\r$", "")
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .select("file", "block", line.alias("line"), (~bare.rlike(_CLOSED)).alias("after_out"), (~bare.rlike(_CLOSES)).alias("after_in"))
    )


@dataclass
class Range:
    """What a task has seen of one range."""

    file: str
    block: int
    ends: list[bool] = field(default_factory=lambda: [False, True])  # state now, for a beginning outside and inside
    tails: list[list[str]] = field(default_factory=lambda: [[], []])  # lines of the record that is open
    head: list[str] = field(default_factory=list)  # lines before the first record's start, for a beginning inside
    closed: bool = False  # whether the record that was open at the beginning has ended
    first_open: bool = True  # whether, for a beginning outside, the first record is still open
    windows: bool | None = None  # whether the first line ends in \r\n

    def add(self, line: str, after: tuple[bool, bool]) -> None:
        if self.windows is None:
            self.windows = line.endswith("\r")
        for begins in (0, 1):
            open_before = self.ends[begins]
            self.ends[begins] = bool(after[open_before])
            if begins and not self.closed:
                self.head.append(line)
                self.closed = not self.ends[1]
            elif open_before:
                self.tails[begins].append(line)
            else:
                self.tails[begins] = [line]
            if not self.ends[begins]:
                self.tails[begins] = []
                if not begins and not _blank(line):
                    self.first_open = False

    def row(self) -> tuple:
        tails = ["\n".join(t) if t else None for t in self.tails]
        return self.file, self.block, *self.ends, tails[0], "\n".join(self.head), tails[1], self.closed, self.first_open, self.windows


def _unix(text: str) -> str:
    return f"{text}\n".replace("\r\n", "\n")[:-1]


def _blank(text: str) -> bool:
    return text in ("", "\r")


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Range | None = None
    done = []
    for batch in batches:
        for file, block, line, out, inside in batch.itertuples(index=False, name=None):
            if held is None or (held.file, held.block) != (file, block):
                if held is not None:
                    done.append(held.row())
                held = Range(file, block)
            held.add(line, (out, inside))
    if held is not None:
        done.append(held.row())
    yield pd.DataFrame(done, columns=[c.split()[0] for c in RANGE.split(", ")])


def _beginnings(ranges: list) -> dict[tuple[str, int], tuple[bool, int | None]]:
    """(begins inside quotes, range in which the open record began) of every range, from the states of those before."""
    found, file, inside, owner = {}, None, False, None
    for row in sorted(ranges, key=lambda r: (r.file, r.block)):
        if row.file != file:
            file, inside, owner = row.file, False, None
        found[row.file, row.block] = inside, owner
        ends = row.in_ends if inside else row.out_ends
        if ends and not (inside and not row.in_closes):  # a record that fills the range stays its owner's
            owner = row.block
        inside = ends
    return found


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files at `path` as text (`record`), in no order, without each file's first one."""
    lines = _lines(spark, path)
    ranges = _stored(lines.mapInPandas(_ranges, RANGE))
    # One row a range, without its text: a file of 1 TB has about 8,000.
    states = ranges.select("file", "block", "out_ends", "in_ends", "in_closes", "windows").collect()
    begins = _beginnings(states)
    firsts = {}
    for file, block in begins:
        firsts[file] = min(block, firsts.get(file, block))
    windows = {r.file for r in states if r.windows and r.block == firsts[r.file]}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, inside, waiting, seen, open_lines = None, False, False, False, []
        for batch in batches:
            made = []
            for file, block, line, out, within in batch.itertuples(index=False, name=None):
                if (file, block) != key:
                    key, open_lines, seen = (file, block), [], False
                    inside, _ = begins[key]
                    waiting = inside  # the first lines belong to a record of an earlier range
                inside = within if inside else out
                if waiting:
                    waiting = inside
                    continue
                open_lines.append(line)
                if not inside:
                    text = "\n".join(open_lines)
                    open_lines = []
                    if _blank(text):
                        continue
                    # The header is the first record of the file's first range.
                    if seen or block != firsts[file]:
                        made.append(_unix(text) if file in windows else text)
                    seen = True
            yield pd.DataFrame({"record": made}, dtype=object)

    whole = lines.mapInPandas(cut, "record string")
    return whole.union(_crossing(ranges, begins, firsts, windows))


def _crossing(ranges: DataFrame, begins: dict, firsts: dict, windows: set) -> DataFrame:
    """Records that cross the borders of ranges, put together from their lines in each; headers are left out."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                clean = _unix if r.file in windows else str
                inside, owner = begins[r.file, r.block]
                if inside:
                    rows.append((r.file, owner, r.block, 0, clean(r.in_head)))
                tail = r.in_tail if inside else r.out_tail
                if isinstance(tail, str):
                    rows.append((r.file, r.block, r.block, 1, clean(tail)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])

    pieces = ranges.mapInPandas(parts, PIECE)
    joined = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "at", "record"))).alias("parts"))
    first = F.create_map(*[F.lit(x) for pair in firsts.items() for x in pair]) if firsts else F.lit(None).cast("map<string, bigint>")
    header = ranges.where(F.col("first_open") & (F.col("block") == first[F.col("file")])).select("file", F.col("block").alias("owner"))
    return joined.join(header, ["file", "owner"], "left_anti").select(F.array_join("parts.record", "\n").alias("record"))


def _stored(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        return df.persist()
    return df.checkpoint(eager=True)


def read(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The rows of the files at `path`; equal to Spark's multi-line reader with the same options."""
    text = F.regexp_replace("record", r"\r$", "")
    parsed = records(spark, path).where(text != "").select(F.from_csv(text, schema.simpleString(), {**options, "multiLine": "true"}).alias("row"))
    return parsed.select("row.*")
