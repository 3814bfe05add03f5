"""Table functions for SQL: sentences, pieces, slots between placeholders, and batches by budget over any table.

register(spark) names them sentences_of, pieces_of, slots_of and budget_batches. The first three take a text and are used with LATERAL; the
last takes a table, partitioned and ordered by the call, keeps all of its columns and adds the batch:

    SELECT * FROM budget_batches(TABLE(rows) PARTITION BY doc_id ORDER BY (para_idx), 'tokens', 200, 5)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StructField, StructType

from bitloom.functions import text as T


@udtf(returnType="nth int, sentence string")
class Sentences:
    """A text's sentences, from 0; none of a null one."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(T.sentence_list(text) if text is not None else [])


@udtf(returnType="nth int, piece string")
class Pieces:
    """A text in pieces of at most so many UTF-8 bytes; put together they are the text."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        yield from enumerate(T.utf8_pieces(text, most) if text is not None else [])


@udtf(returnType="slot int, piece string, is_token boolean")
class Slots:
    """A text cut at its placeholders; what has no letter counts as a token, too."""

    def __init__(self) -> None:
        self.token = re.compile(f"(?i)({T.PLACEHOLDER[4:]})")

    def eval(self, text: str) -> Iterator[tuple]:
        parts = [p for p in self.token.split(text or "") if p]
        for k, p in enumerate(parts):
            yield k, p, bool(self.token.fullmatch(p)) or not any(c.isalpha() for c in p)


@udtf
class BudgetBatches:
    """The rows of each partition as they come, with batch: one closes once its sizes exceed max_sum or its rows max_rows. A null size is 0."""

    def __init__(self) -> None:
        self.batch = self.total = self.held = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, max_sum: AnalyzeArgument, max_rows: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in rows.dataType.fields]
        if not rows.isTable or size.value not in names or "batch" in names:
            raise ValueError("budget_batches takes a table that has the size's column and no column named batch")
        return AnalyzeResult(schema=StructType([*rows.dataType.fields, StructField("batch", IntegerType())]))

    def eval(self, row, size: str, max_sum: int, max_rows: int) -> Iterator[tuple]:
        yield (*row, self.batch)
        self.total, self.held = self.total + (row[size] or 0), self.held + 1
        if self.total > max_sum or self.held > max_rows:
            self.batch, self.total, self.held = self.batch + 1, 0, 0


FUNCTIONS = {"sentences_of": Sentences, "pieces_of": Pieces, "slots_of": Slots, "budget_batches": BudgetBatches}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
