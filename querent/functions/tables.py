"""Chunking as table functions of SQL.

``chunk_text(text, budget, overlap)`` gives (pos, chunk, n_tokens) of one text, to be used with LATERAL. ``chunk_table(TABLE(rows) PARTITION BY (key),
budget, overlap)`` takes rows with a column ``text`` and gives them back with one row a chunk; both are chunked as by ``token_chunks``.

Nulls and edges: null and blank texts have no chunks; a table without a column ``text`` is an error when the query is analysed, as is a budget
below one. An empty table gives no rows. Other columns, whatever their names, are kept; pos, chunk and n_tokens that a table has
already give way to the new ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

CHUNK_TEXT, CHUNK_TABLE = "chunk_text", "chunk_table"


def registered(spark: SparkSession, path: str) -> None:
    """Makes both functions known to ``spark``, with the tokens of the rank file at ``path``."""
    from pyspark.sql import types as T
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    def own() -> list[T.StructField]:
        return [T.StructField("pos", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("n_tokens", T.IntegerType())]

    def checked(budget: AnalyzeArgument | None, overlap: AnalyzeArgument | None) -> None:
        if budget is not None and budget.value is not None and budget.value < 1:
            raise ValueError("a budget is one token at least")
        if overlap is not None and overlap.value is not None and overlap.value < 0:
            raise ValueError("an overlap isn't negative")

    def chunker(budget: int, overlap: int):
        from functools import partial

        from querent.functions.tokens import ordinary_tokens, public_encoding
        from querent.operators.chunking import TokenChunker

        encoding = public_encoding(path)
        encode = partial(ordinary_tokens, encoding)
        return TokenChunker(encode, encoding.decode, budget, overlap), encode

    class ChunkText:
        def __init__(self):
            self.held = {}

        @staticmethod
        def analyze(text: AnalyzeArgument, budget: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
            if not isinstance(text.dataType, T.StringType):
                raise ValueError("what is chunked is a text")
            checked(budget, overlap)
            return AnalyzeResult(T.StructType(own()))

        def eval(self, text: str, budget: int = 128, overlap: int = 50):
            if (budget, overlap) not in self.held:
                self.held[budget, overlap] = chunker(budget, overlap)
            cut, encode = self.held[budget, overlap]
            for pos, chunk in enumerate(cut.chunks(text) if text else ()):
                yield pos, chunk, len(encode(chunk))

    class ChunkTable:
        def __init__(self):
            self.cut = None

        @staticmethod
        def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
            if not rows.isTable or "text" not in rows.dataType.names:
                raise ValueError("what is chunked is a table with a column text")
            checked(budget, overlap)
            new = own()
            kept = [f for f in rows.dataType.fields if f.name not in {"text", *(n.name for n in new)}]
            return AnalyzeResult(T.StructType([*kept, *new]))

        def eval(self, rows, budget: int = 128, overlap: int = 50):
            if self.cut is None:
                self.cut = chunker(budget, overlap)
            cut, encode = self.cut
            kept = [rows[name] for name in rows.__fields__ if name not in ("text", "pos", "chunk", "n_tokens")]
            for pos, chunk in enumerate(cut.chunks(rows["text"]) if rows["text"] else ()):
                yield (*kept, pos, chunk, len(encode(chunk)))

    spark.udtf.register(CHUNK_TEXT, udtf(ChunkText, useArrow=True))
    spark.udtf.register(CHUNK_TABLE, udtf(ChunkTable, useArrow=True))
