"""Fill-in-the-middle: an indexable skip list over a text's lines finds both cuts by rank."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.llm import common

# The strings before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FAN = 4


class SkipList:
    """A sequence of units that is reached by rank, with its offset in code points, through express lanes.

    The lowest lane links every unit to the next one; a unit is also on the lane above with probability
    1/FAN, drawn from its place. A link carries its unit-width and its code-point-width, so a descent
    that adds widths while they fit knows the exact offset of its rank, after about FAN * log(n) links.
    """

    def __init__(self, lengths: list[int]):
        self.units = len(lengths)
        rank, point = np.arange(self.units + 1), np.cumsum([0, *lengths])
        #: From the lowest lane up: unit-widths, code-point-widths, and every node's place on the lane below.
        self.lanes = [(np.diff(rank).tolist(), np.diff(point).tolist(), None)]
        while len(rank) > FAN + 1:
            up = common.mix(rank.astype(np.uint64) + np.uint64(len(self.lanes) << 48)) % np.uint64(FAN) == 0
            up[0] = up[-1] = True
            rank, point = rank[up], point[up]
            self.lanes.append((np.diff(rank).tolist(), np.diff(point).tolist(), np.flatnonzero(up).tolist()))

    def seek(self, rank: int) -> tuple[int, int]:
        """Code points before the unit of this rank (0 to ``units``), and how many links were followed."""
        left, offset, node, links = rank, 0, 0, 0
        for units, points, below in reversed(self.lanes):
            while left and node < len(units) and units[node] <= left:
                left -= units[node]
                offset += points[node]
                node += 1
                links += 1
            node = below[node] if below else node
        return offset, links


def line_lengths(text: str) -> list[int]:
    """Code points of every line with its line feed; nothing follows a last line feed."""
    lengths = [len(line) + 1 for line in text.split("\n")]
    lengths[-1] -= 1
    return lengths if lengths[-1] else lengths[:-1]


def draws(doc_id: int, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32, fixed by document and seed."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform_text(doc_id: int | None, text: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    lengths = line_lengths(text)
    n = len(lengths)
    if not text or doc_id is None or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second, third, fourth = draws(doc_id, seed)
    if third % 100 >= rate:
        return n, "plain", None, None, text
    lines = SkipList(lengths)
    start, end = (lines.seek(r)[0] for r in sorted((first % (n + 1), second % (n + 1))))
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if fourth % 100 < spm:
        return n, "spm", start, end - start, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", start, end - start, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Columns of ``docs(doc_id, text, ...)`` plus ``n, form, prefix_chars, middle_chars, output``.

    A text is a sequence of n lines, each with its line feed. Two ranks drawn from seed and doc_id are
    the cuts; the part between them moves to the end: ``<P>prefix<S>suffix<M>middle`` (psm) or
    ``<S>suffix<P>prefix<M>middle`` (spm, ``spm`` of 100). Texts that hold one of the marks, empty ones,
    and all but ``rate`` of 100 others stay as they are (plain; both counts are null).

    Lines are the units of an indexable skip list whose links carry widths in lines and in code
    points, so both cuts are found by descent and always fall between code points. The work is one
    scan without a shuffle; a draw depends on the document alone, so any task can be run again.

    A null text counts as empty. A row without doc_id has no draws and stays plain. Rows that share a
    doc_id share its draws. A text of one long line can only be cut at its ends. Columns named like
    the added ones are replaced; an empty table gives an empty table.
    """
    plain = docs.drop("n", "form", "prefix_chars", "middle_chars", "output", "_made")
    kind = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"
    schema = plain.withColumn("_made", F.expr(f"cast(null as {kind})")).schema
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ("n", "form", "prefix_chars", "middle_chars", "output")

    def transform(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                made = zip(*(transform_text(doc, text or "", seed, rate, spm) for doc, text in rows))
                struct = pa.StructArray.from_arrays([pa.array(values, t) for values, t in zip(made, types)], names)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, "_made"])

    made = plain.mapInArrow(transform, schema)
    return made.select(*plain.columns, "_made.*")


def restore(output: Column, form: Column) -> Column:
    """The text behind an output: its parts are cut out at the marks and put back in order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
