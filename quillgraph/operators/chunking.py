"""Cutting documents into chunks: windows, sections, sections with a context line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIXED, FIXED_OVERLAP, SECTION, SECTION_OVERLAP = 350, 60, 400, 60
#: Text before the first heading up to this length joins the first section.
PREAMBLE = 120
#: A fixed value: what begins a section.
HEADING = re.compile(r"^(?:第[一二三四五六七八九十百]+[节章条]|[一二三四五六七八九十]+、)[^\n]*$", re.M)
STOPS = "。！？\n"
SCHEMA = "doc_id string, chunk_seq int, section string, char_offset int, raw_text string"


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(offset, stripped text) of windows; a window ends at the last stop in its last two fifths, if there is one."""
    if len(text) <= size:
        if text.strip():
            yield 0, text.strip()
        return
    at = 0
    while True:
        end = min(at + size, len(text))
        if end < len(text):
            floor = at + int(size * 0.6)
            stop = max(text.rfind(s, floor, end) for s in STOPS)
            if stop >= floor:
                end = stop + 1
        if text[at:end].strip():
            yield at, text[at:end].strip()
        if end >= len(text):
            return
        at = max(end - overlap, at + 1)


def sections(text: str) -> list[tuple[str, int, int]]:
    marks = [(m.group().strip(), m.start()) for m in HEADING.finditer(text)]
    if not marks:
        return [("", 0, len(text))]
    head = text[: marks[0][1]].strip()
    out = [(name, at, end) for (name, at), end in zip(marks, [at for _, at in marks[1:]] + [len(text)], strict=True)]
    if head and len(head) <= PREAMBLE:
        out[0] = (out[0][0], 0, out[0][2])
    elif head:
        out.insert(0, ("", 0, marks[0][1]))
    return out


def _pieces(text: str, strategy: str) -> Iterator[tuple[str, int, str]]:
    if strategy == "fixed":
        yield from (("", at, piece) for at, piece in windows(text, FIXED, FIXED_OVERLAP))
        return
    for name, start, end in sections(text):
        # a page without headings is one section as it stands, a section's body is stripped before it is cut
        body = text[start:end] if not name and (start, end) == (0, len(text)) else text[start:end].strip()
        yield from ((name, start + at, piece) for at, piece in windows(body, SECTION, SECTION_OVERLAP))


def chunked(documents: DataFrame, strategy: str) -> DataFrame:
    """documents(doc_id, title, text) -> doc_id, chunk_id, chunk_seq, section, char_offset, raw_text, text."""
    if strategy not in ("fixed", "section", "contextual"):
        raise ValueError(f"unknown strategy {strategy!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, name, at, piece) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for k, (name, at, piece) in enumerate(_pieces(text, strategy))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_seq", "section", "char_offset", "raw_text"])

    pieces = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("string"), "text").mapInPandas(run, SCHEMA)
    out = pieces.withColumn("chunk_id", F.concat("doc_id", F.lit("#c"), F.lpad(F.col("chunk_seq").cast("string"), 2, "0")))
    if strategy != "contextual":
        return out.withColumn("text", F.col("raw_text"))
    titles = documents.select(F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")).alias("title")).dropDuplicates(["doc_id"])
    head = F.substring(F.col("raw_text"), F.lit(1), F.length("section") + 2)
    named = (F.col("section") != "") & ~F.contains(head, F.col("section"))
    line = F.concat(F.lit("【"), "title", F.when(named, F.concat(F.lit("｜"), "section")).otherwise(""), F.lit("】\n"))
    return out.join(titles, "doc_id").withColumn("text", F.concat(line, "raw_text")).drop("title")
