"""Problem 4: cutting oversized texts at natural boundaries.

A text is cut by a hierarchy of separators: sections (heading lines), then inside a section that is still too long
paragraphs, sentences, words and at last characters. Units are packed greedily: a piece ends at the last boundary of
the coarsest level that fits the limit, and the next piece of the same section begins `overlap` characters before that
end. Pieces are substrings of the text, so the text can be put together again from (char_offset, text) exactly.

Only texts over the limit travel to Python (Arrow batches); the length filter runs in the scan stage, and there is no
shuffle of documents.

Edge cases: null and empty texts and those within the limit give no piece; a text without any boundary is cut every
`limit` characters (never between a character and its combining mark, if the limit allows; an overlap that would begin
with such a mark is longer by the marks and their character); repeated rows of chunks
give their pieces once; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources import table

LIMIT, OVERLAP = 400, 60
#: A coarse boundary is taken before a finer one only if the piece is filled to this part.
COARSE_FILL = 0.5

HEADING = re.compile(
    r"^(?:第[一二三四五六七八九十百〇零\d]+[章节節条條回]|[一二三四五六七八九十]+、|#{1,6}[ \t])[^\n]{0,80}$", re.M
)
PARAGRAPH = re.compile(r"\n\s*")
SENTENCE = re.compile(r"[。！？｡!?…]+[”’」』）】》»\"')\]]*|\.[”’»\"')\]]*(?=\s|$)")
WORD = re.compile(r"[\s，、；：,;:]+")

SCHEMA = "item_id string, piece_no int, char_offset long, section string, text string"


def sections(text: str) -> list[tuple[int, int, str]]:
    """(start, end, heading) of each section; what stands before the first heading has the heading ''."""
    marks = [(m.start(), m.group().strip()) for m in HEADING.finditer(text)]
    if not marks or text[: marks[0][0]].strip():
        marks.insert(0, (0, ""))
    else:
        marks[0] = (0, marks[0][1])
    return [(s, e, h) for (s, h), e in zip(marks, [s for s, _ in marks[1:]] + [len(text)], strict=True)]


def _joined(text: str, at: int) -> bool:
    """Whether the character at `at` belongs to the one before it."""
    return at < len(text) and (unicodedata.combining(text[at]) != 0 or text[at] in "‍️" or text[at - 1] == "‍")


def cut_section(text: str, start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of text[start:end]."""
    if end - start <= limit:
        return [(start, end)]
    levels = [[m.end() for m in p.finditer(text, start, end)] for p in (PARAGRAPH, SENTENCE, WORD)]
    spans, at = [], start
    while end - at > limit:
        least, most = at + overlap, at + limit
        stop = 0
        for fill, ends in [(COARSE_FILL, levels[0]), (COARSE_FILL, levels[1]), (0, levels[0]), (0, levels[1]), (0, levels[2])]:
            k = bisect_right(ends, most)
            if k and ends[k - 1] > max(least, at + fill * limit):
                stop = ends[k - 1]
                break
        if not stop:
            stop = most
            while stop > least + 1 and _joined(text, stop):
                stop -= 1
            if _joined(text, stop):
                stop = most
        spans.append((at, stop))
        # the shared part begins with a whole character: it grows by the marks that would be cut off theirs
        begin = stop - overlap
        while begin > at + 1 and _joined(text, begin):
            begin -= 1
        at = stop - overlap if _joined(text, begin) else begin
    return [*spans, (at, end)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str, str]]:
    """(char_offset, heading, piece) of a text."""
    return [
        (s, heading, text[s:e])
        for start, end, heading in sections(text)
        for s, e in cut_section(text, start, end, limit, overlap)
    ]


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """items(item_id, section, text) -> one row per piece of the texts over `limit` characters.

    A piece without a heading of its own keeps the item's section. Needs 0 <= overlap < limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (i, k, at, heading or own, piece)
                for i, own, text in zip(batch["item_id"], batch["section"], batch["text"], strict=True)
                for k, (at, heading, piece) in enumerate(pieces(text, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["item_id", "piece_no", "char_offset", "section", "text"])

    long = items.select(F.col("item_id").cast("string"), F.col("section").cast("string"), "text").where(F.length("text") > limit)
    return long.mapInPandas(run, SCHEMA)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("id").alias("item_id"), F.lit(None).cast("string").alias("section"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.col("id").alias("item_id"), "section", "text")
    return documents.unionByName(chunks.where(F.length("text") > LIMIT).dropDuplicates(["item_id", "text"]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_items(spark, sf_dir)).where("piece_no = 0").select("item_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_items(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {
    "p4_found": """
        SELECT id AS item_id FROM documents WHERE length(text) > 400
        UNION
        SELECT id AS item_id FROM chunks WHERE length(text) > 400"""
}
