"""Text of HTML pages, by the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Text(HTMLParser):
    """Pieces of text between tags: entities are signs, quoted attributes may hold any sign, comments and the insides of scripts and styles are no text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.inside += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.pieces.append(data)


def text_of(html: str | None, separator: str = " ") -> str:
    """The pieces of text of a page, joined."""
    if not html:
        return ""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return separator.join(parser.pieces)


def drop_markup(df: DataFrame, column: str, separator: str = " ") -> DataFrame:
    """`df` with the text of the pages in `column` in their place; null and empty pages have an empty text."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([text_of(x, separator) for x in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.withColumn(column, F.col(column).cast("string")).mapInArrow(run, df.withColumn(column, F.col(column).cast("string")).schema)
