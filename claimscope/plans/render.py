"""HTML reports from rows; every value is escaped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from claimscope.functions.html import escaped
from claimscope.functions.urls import icon
from claimscope.rules import REPORT_HEADINGS


def _cell(value: Column) -> Column:
    return F.concat(F.lit("<td>"), value, F.lit("</td>"))


def report_row(link: Column, title: Column, *cells: Column) -> Column:
    """One table row: the title as a link with its host's icon, then the cells; nulls are empty."""
    text = lambda c: F.coalesce(escaped(c.cast("string")), F.lit(""))
    first = F.concat(F.lit("<img src='"), text(icon(link)), F.lit("' /><a href='"), text(link), F.lit("'>"), text(title), F.lit("</a>"))
    return F.concat(F.lit("<tr>"), _cell(first), *[_cell(text(c)) for c in cells], F.lit("</tr>"))


def report_table(rows: DataFrame, keys: list[str], order: str, row: str, headings: tuple[str, ...] = REPORT_HEADINGS) -> DataFrame:
    """(keys, html, n): a table per request, its rows in order. A table is one value: ``keys`` must bound its rows."""
    head = "<table><tr>" + "".join(f"<th>{h}</th>" for h in headings) + "</tr>"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(row).alias("row")))), lambda x: x["row"]), "")
    return rows.groupBy(*keys).agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("html"), F.count(F.lit(1)).alias("n"))


#: Rows of a part of a report where the call does not say otherwise.
PART_ROWS = 100


class ReportParts:
    """A report as a table function: ``SELECT * FROM report_parts(TABLE(rows) PARTITION BY (...) ORDER BY (...), 'row', 100)``.

    The table's column named by the second argument holds table rows as ``report_row`` makes them; the others are handed
    on: of each part of a partition come its number (from 0), its html, its number of rows, and the first row's values of
    the other columns. A part ends after so many rows (third argument), so no value grows with its partition.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, row: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        if row.isTable or row.value not in rows.dataType.names:
            raise ValueError("the second argument must name a column of the table")
        if most is not None and (most.value is None or most.value < 1):
            raise ValueError("a part needs a row at least")
        others = [f for f in rows.dataType.fields if f.name != row.value]
        return AnalyzeResult(StructType([StructField("part", LongType()), StructField("html", StringType()), StructField("n", LongType()), *others]), withSinglePartition=False)

    def __init__(self):
        self.head = "<table><tr>" + "".join(f"<th>{h}</th>" for h in REPORT_HEADINGS) + "</tr>"
        self.cells, self.first, self.part = [], None, 0

    def _done(self):
        out = (self.part, self.head + "".join(self.cells) + "</table>", len(self.cells), *self.first)
        self.cells, self.first, self.part = [], None, self.part + 1
        return out

    def eval(self, rows: Row, row: str, most: int = PART_ROWS):
        values = rows.asDict()
        self.cells.append(values.pop(row) or "")
        if self.first is None:
            self.first = tuple(values.values())
        if len(self.cells) >= most:
            yield self._done()

    def terminate(self):
        if self.cells:
            yield self._done()


def report_parts():
    """The function, for ``spark.udtf.register``."""
    return F.udtf(ReportParts)


def panel(text: Column, title: Column, description: Column, source: Column, url: Column) -> Column:
    """A result panel; what is missing shows as N/A, line ends as breaks."""
    shown = lambda c: F.replace(escaped(F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))), F.lit("\n"), F.lit("<br>"))
    parts = [("", text), ("標題: ", title), ("描述: ", description), ("來源: ", source), ("網址: ", url)]
    return F.concat(*[F.concat(F.lit(f"<p>{name}"), shown(c), F.lit("</p>")) for name, c in parts])
