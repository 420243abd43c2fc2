"""Cells of tables in reading order, swept row by row over a tree of how far down each column is taken.

What happens to a cell depends on the kept cells before it, so a table is read by
one task; but only the tree is held there, which grows with the columns that
spans end at and not with the cells. Cells come in sorted batches, so neither a
table nor a document has to fit in memory. Each cell costs some thirty steps,
whatever came before it. Columns, rows and spans are 32-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LEAVES = 1 << 33


class Reach:
    """The row up to which each column is taken: maxima over ranges of columns, in nodes that are made when used."""

    def __init__(self):
        self.until: dict[int, int] = {}

    def cover(self, start: int, end: int, row: int) -> None:
        """Takes columns from start up to, not including, end, in all rows before row."""
        a, b = start + LEAVES + LEAVES // 2, end + LEAVES + LEAVES // 2
        while a < b:
            if a & 1:
                self._raise(a, row)
                a += 1
            if b & 1:
                b -= 1
                self._raise(b, row)
            a, b = a >> 1, b >> 1

    def _raise(self, node: int, row: int) -> None:
        if self.until.get(node, row - 1) < row:
            self.until[node] = row

    def taken(self, column: int, row: int) -> int | None:
        """The end of the widest range around column that is taken in row; None if the column is free."""
        node, width, end = column + LEAVES + LEAVES // 2, 0, None
        while node:
            if self.until.get(node, row) > row:
                end = ((node + 1) << width) - LEAVES - LEAVES // 2
            node, width = node >> 1, width + 1
        return end

    def free(self, column: int, row: int) -> int:
        """The first column from column on that is free in row."""
        while (end := self.taken(column, row)) is not None:
            column = end
        return column


def keeper() -> Callable:
    """A function of (row, column, colspan, rowspan), called in order, that tells if no kept cell before covers this one."""
    reach = Reach()

    def keeps(row, column, colspan, rowspan):
        if row is None or column is None:
            return True
        if reach.taken(column, row) is not None:
            return False
        if colspan is not None and rowspan is not None and rowspan > 0:
            reach.cover(column, column + colspan, row + rowspan)
        return True

    return keeps


def placer() -> Callable:
    """A function of (row, colspan, rowspan), called in order, that tells the column where the cell falls."""
    reach, at, start = Reach(), None, 0

    def place(row, colspan, rowspan):
        nonlocal at, start
        if row != at:
            at, start = row, 0
        column = reach.free(start, row)
        if colspan is not None:
            start = max(start, column + colspan)
            if rowspan is not None and rowspan > 0:
                reach.cover(column, column + colspan, row + rowspan)
        return column

    return place


def kept(cells: Iterable[dict]) -> list[dict]:
    """Of the sorted cells of one table, those that no kept cell before covers."""
    keeps = keeper()
    return [c for c in cells if keeps(c["row_index"], c["column_index"], c["colspan"], c["rowspan"])]


def _sweep(df: DataFrame, table: list[str], order: list[str], numbers: list[str], begin: Callable, found: Callable, schema: StructType) -> DataFrame:
    """Calls begin() for each table and what it returns for each cell, in order; found makes a batch of the answers."""
    def run(batches):
        at, told = None, None
        for batch in batches:
            answers = []
            tables = zip(*[batch.column(batch.schema.get_field_index(t)).to_pylist() for t in table]) if table else [()] * batch.num_rows
            cells = zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in numbers])
            for key, cell in zip(tables, cells):
                if told is None or key != at:
                    at, told = key, begin()
                answers.append(told(*cell))
            yield found(batch, answers)

    quoted = [F.col(f"`{c}`") for c in [*table, *order]]
    dealt = df.repartition(*quoted[: len(table)]) if table else df.coalesce(1)
    return dealt.sortWithinPartitions(*quoted).mapInArrow(run, schema)


def kept_cells(df: DataFrame, table: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """The cells (row_index, column_index, colspan, rowspan, …) that no earlier kept cell of their table covers.

    Earlier is by row, column, colspan, rowspan, then ties. Cells without a row or
    column stay and cover nothing, nor do cells with a null or empty span. Repeated cells
    cover each other, so the first stays.
    """
    cell = ["row_index", "column_index", "colspan", "rowspan"]
    return _sweep(df, table, [*cell, *ties], cell, keeper, lambda batch, kept: batch.filter(pa.array(kept, pa.bool_())), df.schema)


def placed_cells(df: DataFrame, table: list[str], name: str = "column") -> DataFrame:
    """Cells (row, k, colspan, rowspan, …) with the column where each falls, by row and k.

    That is the first column behind the cells before it in its row that no cell of a
    row above reaches into. row must not be null.
    """
    schema = StructType([*df.schema.fields, StructField(name, LongType())])
    found = lambda batch, columns: batch.append_column(name, pa.array(columns, pa.int64()))
    return _sweep(df, table, ["row", "k"], ["row", "colspan", "rowspan"], placer, found, schema)
