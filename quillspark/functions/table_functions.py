"""Splitter and manual parser as table functions of SQL.

    SELECT d.doc_id, p.* FROM documents d, LATERAL fixed_pieces(d.text, 800, 120) p
    SELECT * FROM manual_blocks(TABLE(lines))

`manual_blocks` takes classified lines (`segments.marked`) and asks Spark for
one source file at a time, in the order of its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators import segments, split, structure


class _FixedPieces:
    """Windows of a text: (chunk_index, piece)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError("the first argument is the text")
        wide = split.CHUNK_SIZE if size is None else size.value
        shared = split.OVERLAP if overlap is None else overlap.value
        if wide is not None and shared is not None and not 0 <= shared < wide:
            raise ValueError("the overlap must be at least 0 and less than the chunk size")
        return AnalyzeResult(StructType().add("chunk_index", IntegerType()).add("piece", StringType()))

    def eval(self, text: str | None, size: int = split.CHUNK_SIZE, overlap: int = split.OVERLAP) -> Iterator[tuple[int, str]]:
        yield from enumerate(split.pieces_of(text, size, overlap, split.FIXED_SHARE, (tuple("。；\n"),), False))


class _ManualBlocks:
    """Blocks of a source file's lines; `structure.finished` adds what follows from their text."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        held = {f.name: f.dataType for f in lines.dataType.fields} if lines.isTable else {}
        missing = [c for c in ("source_file", "doc_id", "page", "n", "kind", "head", "said", "token") if c not in held]
        if missing:
            raise ValueError(f"the argument is a table of classified lines; it lacks {', '.join(missing)}")
        schema = StructType().add("source_file", held["source_file"]).add("doc_id", held["doc_id"])
        for c in ("chapter", "section", "subsection", "raw"):
            schema = schema.add(c, StringType())
        for c in ("start_page", "end_page"):
            schema = schema.add(c, held["page"])
        return AnalyzeResult(schema.add("block_index", IntegerType()), partitionBy=[PartitioningColumn("source_file")], orderBy=[OrderingColumn("page"), OrderingColumn("doc_id"), OrderingColumn("n")])

    def __init__(self) -> None:
        self.reader, self.lines, self.kept, self.source = segments.Reader(), [], 0, None

    def _closed(self, headings: list[str]) -> Iterator[tuple]:
        lines, self.lines = self.lines, []
        raw = "\n".join(x[2] for x in lines).strip()
        if len(raw) >= structure.LEAST_BLOCK:
            yield (self.source, lines[0][1], *(h or None for h in headings), raw, lines[0][0], lines[-1][0], self.kept)
            self.kept += 1

    def eval(self, row: Row) -> Iterator[tuple]:
        self.source = row["source_file"]
        if row["kind"] in ("blank", "noise"):
            return
        before = list(self.reader.headings)
        text, opens = self.reader.read(row["kind"], row["head"], row["token"])
        if opens or (not text and self.reader.state == segments.EMPTY):
            yield from self._closed(before)
        if text:
            self.lines.append((row["page"], row["doc_id"], row["said"]))

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed(self.reader.headings)


fixed_pieces = udtf(_FixedPieces)
manual_blocks = udtf(_ManualBlocks)


def register(spark: SparkSession) -> None:
    """Make both known to SQL, under their names here."""
    spark.udtf.register("fixed_pieces", fixed_pieces)
    spark.udtf.register("manual_blocks", manual_blocks)
