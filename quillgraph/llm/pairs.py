"""Problem 6: defective answers to questions, one defect each.

1. Openings: the first sentence of an answer, with everything masked that it shares with its question. Openings that say
   the same to unrelated questions carry no answer. Equal masked openings form classes; classes meet under
   their rarest character triples (prefix filter, which loses no pair), every candidate is verified by its exact Jaccard
   similarity, and clusters are the connected components; a cluster's questions and witnesses are added up. A cluster that recurs over enough questions and whose answers are mostly marked as refused is a refusal
   template (single marks are unreliable, their majority is not).
2. Copies, languages and endings are checked per pair. The ending check uses statistics of all answers: how often the
   last characters are followed by a stop rather than by more text; `finish_reason` only lowers the bar.

Order of defects, the first one holds: empty, copied, refusal (where none is expected), wrong_language, truncated.

Edge cases: a null text is empty; answers without a question are checked for emptiness and ending only; null witnesses
count as unknown; repeated rows give one row; repeated results count once; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.crosssplit import hashes
from quillgraph.llm.grouping import components
from quillgraph.llm.lookalikes import FOREIGN, IS_IGNORABLE, LATIN
from quillgraph.llm.text import TO_SIMPLIFIED
from quillgraph.plans import written
from quillgraph.sources import table

#: Least similarity of openings of one cluster (character triples).
JACCARD = 0.8
#: Size of the hashed counts of triples (as a power of two), and how many openings under one triple make a block.
CELL_BITS, BLOCK = 20, 512
#: So many edges between openings, both directions counted, are joined in one task.
FEW = 1 << 18
#: A refusal template stands with this many different questions, and this share of its known marks says refused.
QUESTIONS, REFUSED = 4, 0.5
#: Size of the hashed table of endings: the proven bound of what is collected and broadcast.
BUCKETS = 1 << 22
#: Cells of a hashed table that reach the driver in one row.
CELLS = 1 << 12
#: Endings seen less often than this say nothing.
SEEN = 3
#: Least share of stops after an ending that counts as complete, and as complete though the result says it was cut.
COMPLETE, COMPLETE_IF_CUT = 0.3, 0.5

TOKEN = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_㐀-鿿぀-ヿ]+")
CITATION = re.compile(r"[\[［【]\s*\d{1,3}(?:\s*[,，、]\s*\d{1,3})*\s*[\]］】]")
#: Labels before an answer and before a repeated question.
LABEL = re.compile(r"^\s*(?:答案?|回答|答复|answer|a|réponse|antwort)\s*[:：]\s*", re.I)
ECHO = re.compile(r"^\s*(?:您?问的是|你问的是|问题是?|问|the question is|you asked|question|q|问题问的是)\s*[:：]?\s*", re.I)
MIXED = re.compile(r"(?:[a-z][^\W\d_]*[\u0370-\u052f]|[\u0370-\u052f]+[a-z])[^\W\d_]*", re.I)
TO_LATIN = str.maketrans(FOREIGN, LATIN)
#: Cheap tests before dearer replacements.
BRACKETS, FOREIGN_LETTER = re.compile(r"[\[［【]"), re.compile("[\u0370-\u052f]")
OLD_STYLE = re.compile("[" + "".join(map(chr, TO_SIMPLIFIED)) + "]")
MARKS = re.compile("[（(“\"„«《「『]")
ASIDE = re.compile(r"[（(][^（()）]{0,120}[)）]")
QUOTED = re.compile(r"[“\"„«《「『][^”\"“»》」』]{0,120}[”\"“»》」』]")
SENTENCE_END = re.compile(r"[。！？!?\n]|\.(?=\s|$)")
STOPS = "。！？!?.…"
CLOSERS = "”\"’'）)】]》」』»"
#: Requests for a language inside a question.
ASKS = [("en", re.compile(r"英文|英语|in english", re.I)), ("zh", re.compile(r"中文|汉语|in chinese", re.I)), ("de", re.compile(r"德文|德语|in german|auf deutsch", re.I)), ("fr", re.compile(r"法文|法语|in french|en français", re.I))]
#: Frequent function words.
FUNCTION = {
    "en": frozenset("the of is are was were and in to it by for on that with at as not be this from only which what his her they there can could do does did has have had i you we be an a".split()),
    "de": frozenset("der die das und ist im in auf wird den dem des ein eine einer von zu mit es sich als nicht an war bis nur selbst ganz am steht über sie er so hatte wurde".split()),
    "fr": frozenset("le la les est et dans une un des du de à au il elle ce cette qui que en pour par sur pas sont se son sa ne plus avec fut".split()),
}


def folded(text: str) -> str:
    """Without citations and invisible characters, one width, case and style."""
    t = CITATION.sub(" ", text) if BRACKETS.search(text) else text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        if OLD_STYLE.search(t):
            t = t.translate(TO_SIMPLIFIED)
        t = IS_IGNORABLE.sub("", t)
        if FOREIGN_LETTER.search(t):
            t = MIXED.sub(lambda m: m.group().translate(TO_LATIN), t)
    return t.lower()


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def shared(answer: list[str], question: list[str]) -> list[bool]:
    """Which tokens of the answer stand in the question: words, and CJK characters in runs of two."""
    pairs, words = set(zip(question, question[1:], strict=False)), {w for w in question if len(w) > 1}
    out = [w in words for w in answer]
    for k in range(len(answer) - 1):
        if (answer[k], answer[k + 1]) in pairs:
            out[k] = out[k + 1] = True
    return out


def opening(answer: str, question: list[str]) -> str:
    """The masked first sentence of a folded answer."""
    text = LABEL.sub("", answer).strip()
    m = SENTENCE_END.search(text)
    own = tokens(text[: m.start()] if m else text)
    out: list[str] = []
    for w, hit in zip(own, shared(own, question), strict=True):
        if not hit:
            out.append(w)
        elif not out or out[-1] != "■":
            out.append("■")
    return " ".join(out)


#: More letters than any label has.
WORDY = re.compile(r"(?:[^\W\d_][^\n]{0,3}?){12}")


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    if WORDY.search(text):
        return False
    left = LABEL.sub("", CITATION.sub(" ", unicodedata.normalize("NFKC", text).strip()))
    left = "".join(c for c in left if unicodedata.category(c) != "Cf").strip()
    return not LABEL.sub("", left + ":").strip(" :") or all(unicodedata.category(c)[0] in "PZC" or c in "-~" for c in left)


def is_copy(answer: str, q: list[str]) -> bool:
    """Whether a folded answer only repeats the question, given by its tokens."""
    if len(q) < 3:
        return False
    own = tokens(ECHO.sub("", LABEL.sub("", answer)))
    if not own or len(own) < 0.8 * len(q):
        return False
    squeezed, asked = " ".join(own), " ".join(q)
    if own[-2:] != q[-2:] and asked not in squeezed:
        return False
    rest = squeezed.replace(asked, " ").split()
    if len(rest) < len(own):
        return len(rest) <= 2
    hit = shared(own, q)
    new = hit.count(False)
    back = shared(q, own).count(False)
    return new <= max(1, 0.06 * len(own)) and back <= max(1, 0.06 * len(q)) and own[-2:] == q[-2:]


@lru_cache(maxsize=50_000)
def value_tokens(gold: str | None) -> list[str]:
    return tokens(folded(gold)) if gold else []


@lru_cache(maxsize=50_000)
def asked_for(question: str) -> tuple[list[str], str | None]:
    """The tokens of a folded question and the language that it wants."""
    q = folded(question)
    return tokens(q), wanted_language(q)


def wanted_language(question: str) -> str | None:
    for lang, asks in ASKS:
        if asks.search(question):
            return lang
    return language(question, [])


def language(text: str, known: list[str]) -> str | None:
    """The language of the running words of a text: without quotations and words of `known`."""
    if MARKS.search(text):
        text = ASIDE.sub(" ", QUOTED.sub(" ", text))
    own = tokens(text)
    left = [w for w, hit in zip(own, shared(own, known), strict=True) if not hit] if known else own
    # a token beyond ASCII is one CJK character or a word
    signs = [w for w in left if "぀" <= w[0] <= "鿿"]
    kana = sum(w <= "ヿ" for w in signs) if signs else 0
    cjk = sum(w >= "㐀" for w in signs) if signs else 0
    if kana >= 3 and kana >= 0.2 * (kana + cjk):
        return "ja"
    words = [w for w in left if w.isalpha() and not "぀" <= w[0] <= "鿿"] if len(signs) < len(left) else []
    if cjk >= 3 and cjk >= len(words):
        return "zh"
    if len(words) < 3:
        return None
    counts = {lang: sum(w in own_words for w in words) for lang, own_words in FUNCTION.items()}
    best = max(counts, key=lambda k: (counts[k], k == "en"))
    return best if counts[best] >= 2 and len(words) >= 3 else None


#: Lengths, in tokens, of the endings that are looked up.
SPANS = (5, 3, 2, 1)
STOP = re.compile(r"[。！？!?…■]+|\.(?=\s|$)")


def numbered(text: str) -> list[str]:
    """The tokens of a folded text; digits are alike."""
    return tokens(re.sub(r"\d+", "0", text))


def span_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """For each position the hash of the k tokens that end there (meaningless before the k-th)."""
    out = np.full(len(h), k, np.uint64)
    for j in range(k - 1, -1, -1):
        out = (out ^ np.concatenate([np.zeros(j, np.uint64), h[: len(h) - j]])[: len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out & np.uint64(BUCKETS - 1)


def tail(text: str) -> str:
    """A text without its last citations, spaces and emoji."""
    t = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "So", "Sk"))
    while True:
        u = CITATION.sub(lambda m: "" if m.end() == len(m.string) else m.group(), t.rstrip())
        if u == t:
            return u
        t = u


def gathered(counts: DataFrame, size: int, kind: type, least: int = 1) -> np.ndarray:
    """counts(at, one column or more, several rows a cell) -> the sums in a table of `size` cells, a row for each column.

    Cells whose first column is under `least` stay 0. The executors add up and fill the table, so that the driver gets its bytes,
    compressed, in rows of `CELLS`, never a row for each cell.
    """
    names = [c for c in counts.columns if c != "at"]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = np.zeros((len(names), size), kind)
        for batch in batches:
            for row, name in zip(table_, names, strict=True):
                row[batch["at"].to_numpy()] = batch[name].to_numpy()
        cells = table_.reshape(len(names), -1, CELLS)
        for block in np.flatnonzero(cells.any(axis=(0, 2))):
            yield pd.DataFrame({"block": np.int32([block]), "cells": [zlib.compress(cells[:, block].tobytes(), 1)]})

    sums = counts.withColumn("block", F.expr(f"at div {CELLS}")).repartition("block").groupBy("block", "at").agg(*(F.sum(c).alias(c) for c in names))
    out = np.zeros((len(names), size), kind)
    for r in sums.where(F.col(names[0]) >= least).select("at", *names).mapInPandas(fill, "block int, cells binary").collect():
        out[:, r.block * CELLS : (r.block + 1) * CELLS] = np.frombuffer(zlib.decompress(r.cells), kind).reshape(len(names), CELLS)
    return out


def count_endings(texts: DataFrame) -> np.ndarray:
    """Hashed counts of character runs (row 0) and of those before a stop (row 1) over all texts(text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            flat: list[str] = []
            for text in batch["text"]:
                t = STOP.sub(" ■ ", folded(CITATION.sub(" ■ ", text)))
                flat += re.findall(TOKEN.pattern + "|■", re.sub(r"\d+", "0", t))
                flat.append("□")
            h = hashes(flat)
            kind = np.array([0 if w == "□" else 1 if w == "■" else 2 for w in flat])
            begin = np.maximum.accumulate(np.where(kind < 2, np.arange(len(flat)), -1))
            inside = (kind[:-1] == 2) & (kind[1:] > 0)
            stops = inside & (kind[1:] == 1)
            for k in SPANS:
                own = span_hashes(h, k)[:-1].astype(np.int64)
                long = np.arange(len(own)) - begin[:-1] >= k
                total[0] += np.bincount(own[inside & long], minlength=BUCKETS)
                total[1] += np.bincount(own[stops & long], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"at": at.astype(np.int32), "n": total[0][at], "stops": total[1][at]})

    return gathered(texts.where(F.length("text") > 0).select("text").mapInPandas(count, "at int, n long, stops long"), BUCKETS, np.float32, SEEN)


def completeness(text: str, gold: str | None, counts: np.ndarray) -> float:
    """How sure the end of a text is an end: 1 for a stop, a value or a citation, else the share of stops after such ends.

    gold: a value that completes an answer.
    """
    if (seen := text.rstrip()) and seen[-1] in STOPS:
        return 1.0
    bare = IS_IGNORABLE.sub("", text).rstrip()
    end = tail(text)
    if not end or end[-1] in STOPS or end[-1] in CLOSERS:
        return 1.0
    if unicodedata.category(end[-1])[0] == "P":
        return 0.0
    if len(end) < len(bare):  # a citation or an emoji closes it
        return 1.0
    t = folded(end).strip()
    if gold and t.endswith(folded(gold).strip()):
        return 1.0
    own = numbered(t)
    h = hashes(own) if own else np.zeros(0, np.uint64)
    for k in SPANS:
        if len(own) >= k:
            at = int(span_hashes(h[-k:], k)[-1])
            if counts[0, at] >= SEEN:
                return float(counts[1, at] / counts[0, at])
    return 0.0


def grams(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of the distinct character triples of texts, ordered by both; a code is the three code points."""
    padded = [t.ljust(3, "\0") for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    inside = rows[:-2] == rows[2:]
    codes = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[inside]
    rows = rows[:-2][inside]
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    return rows[first], codes[first]


def _mixed(codes: np.ndarray) -> np.ndarray:
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _cells(codes: np.ndarray) -> np.ndarray:
    return (_mixed(codes) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefixes(texts: Iterable[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and whether it is in the short prefix, of the rarest triples of texts.

    Two texts within the similarity share a triple of the short prefix of the one with fewer triples and the long prefix of
    the other, if all texts order their triples alike, here by hashed count and code.
    """
    rows, codes = grams(texts)
    order = np.lexsort((codes, counts[_cells(codes)], rows))
    rows, codes = rows[order], codes[order]
    size = np.bincount(rows)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    n = size[rows]
    long = place <= n - np.ceil(JACCARD * n - 1e-9)
    short = place <= n - np.ceil(2 * JACCARD / (1 + JACCARD) * n - 1e-9)
    return rows[long], codes[long], short[long]


def _counted(classes: DataFrame, cells_of: Callable[[Iterable[str]], np.ndarray]) -> np.ndarray:
    """Hashed counts over all openings, of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(cells_of(batch["opening"]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": total[at]})

    return gathered(classes.select("opening").mapInPandas(count, "at int, n long"), 1 << CELL_BITS, np.int64)[0]


def _linked(keys: np.ndarray, short: np.ndarray, long: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the texts of one block whose similarity is high enough: a text and the smallest key that it reaches.

    Only texts of `short` are compared with those of `long`.
    """
    rows, codes = grams(texts)
    words, at = np.unique(codes, return_inverse=True)
    size = np.bincount(rows)
    held = np.zeros((len(texts), len(words)), np.float32)
    held[rows, at] = 1
    x, y = np.flatnonzero(short), np.flatnonzero(long)
    common = (held[x] @ held[y].T).astype(np.float64)
    a, b = np.nonzero(common >= JACCARD * (size[x][:, None] + size[y][None, :] - common) - 1e-9)
    a, b = x[a], y[b]
    a, b = a[keys[a] != keys[b]], b[keys[a] != keys[b]]
    least = keys.copy()
    while len(a):
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        if (least == before).all():
            break
    moved = least != keys
    return list(zip(keys[moved].tolist(), least[moved].tolist(), strict=True))


def links(classes: DataFrame, size: int = BLOCK) -> DataFrame:
    """classes(key, opening) -> a, b: links over which all openings within the similarity are joined.

    Prefix filter: openings meet under the triples of their prefixes, which no pair within the similarity escapes. An opening
    is compared with the others under one triple in blocks of about `size`, and a block gives a link for each member, not
    each pair.
    """
    context = classes.sparkSession.sparkContext
    counts = context.broadcast(_counted(classes, lambda texts: _cells(grams(texts)[1])))
    meetings = context.broadcast(_counted(classes, lambda texts: _cells(prefixes(texts, counts.value)[1])))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            key, opening = batch["key"].to_numpy(), batch["opening"].to_numpy()
            rows, codes, short = prefixes(opening, counts.value)
            met = meetings.value[_cells(codes)]
            rows, codes, short = rows[met > 1], codes[met > 1], short[met > 1]
            parts = -(-met[met > 1] // size)
            own = (_mixed(key[rows]) >> np.uint64(33)).astype(np.int64) % parts
            one = parts == 1
            out = [(_mixed(codes[one]), rows[one], short[one], np.ones(one.sum(), bool))]
            # block (s, l) of a triple compares part s of the short prefixes with part l of the long ones
            for is_short in (True, False):
                use = ~one & short if is_short else ~one
                n = parts[use]
                other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                mine = np.repeat(own[use], n)
                s, l = (mine, other) if is_short else (other, mine)
                out.append((_mixed(np.repeat(codes[use], n)) ^ _mixed((s << 31) + l + 1), np.repeat(rows[use], n), np.full(len(mine), is_short), np.full(len(mine), not is_short)))
            block, at, short, long = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pd.DataFrame({"block": block.astype(np.int64), "key": key[at], "short": short, "long": long, "opening": opening[at]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in chain(batches, [None]):
            rows = left if batch is None else batch if left is None else pd.concat([left, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            block = rows["block"].to_numpy()
            ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(rows))
            starts = np.append(0, ends[:-1])
            if batch is not None:  # the last block may go on
                left = rows.iloc[starts[-1] :]
                starts, ends = starts[:-1], ends[:-1]
            key, short, long, text = (rows[c].to_numpy() for c in ("key", "short", "long", "opening"))
            found = [link for i, j in zip(starts, ends, strict=True) if j - i > 1 and short[i:j].any() for link in _linked(key[i:j], short[i:j], long[i:j], text[i:j])]
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    blocks = classes.select("key", "opening").mapInPandas(spread, "block long, key long, short boolean, long boolean, opening string")
    return blocks.repartition("block").sortWithinPartitions("block").mapInPandas(compare, "a long, b long").distinct()


def templates(openings: DataFrame) -> DataFrame:
    """openings(opening, question_key, refused) -> opening, template (key of one opening of its cluster) of the refusals."""
    classes = openings.where("opening <> ''").groupBy("opening").agg(
        F.approx_count_distinct("question_key").alias("questions"),
        F.sum(F.when(F.col("refused"), 1).otherwise(0)).alias("yes"),
        F.count("refused").alias("known"),
    )
    classes = written(classes.withColumn("key", F.xxhash64("opening")), "openings")
    joined = components(written(links(classes), "links"), few=FEW).select(F.col("vertex").alias("key"), "component")
    clustered = classes.join(joined, "key", "left").withColumn("template", F.coalesce("component", "key"))
    refusals = (
        clustered.groupBy("template")
        .agg(F.sum("questions").alias("questions"), F.sum("yes").alias("yes"), F.sum("known").alias("known"))
        .where((F.col("questions") >= QUESTIONS) & (F.col("yes") > REFUSED * F.col("known")))
    )
    return clustered.join(refusals.select("template"), "template").select("opening", "template")


def defects(answers: DataFrame, questions: DataFrame, results: DataFrame) -> DataFrame:
    """answers(answer_id, question_id, text, refused, result_key), questions(id, question, gold_answer, expect_refusal),
    results(result_key, finish_reason) -> answer_id, defect."""
    asked = questions.select(F.col("id").alias("question_id"), "question", "gold_answer", "expect_refusal").dropDuplicates(["question_id"])
    # several rows of one result count as cut only if all known reasons say so
    ends = results.where("result_key is not null").groupBy("result_key").agg(F.min(F.col("finish_reason").isin("length", "max_tokens")).alias("cut"))
    rows = answers.select("answer_id", "question_id", "text", "refused", "result_key").join(asked, "question_id", "left")
    counts = answers.sparkSession.sparkContext.broadcast(count_endings(answers))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False, name="Pair"):
                q, wanted = asked_for(r.question) if r.question else ([], None)
                defect, first, whole = None, "", 1.0
                if is_empty(r.text):
                    defect = "empty"
                elif is_copy(text := folded(r.text), q):
                    defect = "copied"
                else:
                    first = opening(text, q)
                    gold = r.gold_answer if isinstance(r.gold_answer, str) else None
                    own = language(text, q + value_tokens(gold)) if wanted else None
                    if wanted and own and own != wanted:
                        defect = "wrong_language"
                    whole = completeness(r.text, gold, counts.value)
                expected = None if r.expect_refusal is None else bool(r.expect_refusal)
                out.append((r.answer_id, r.question_id, r.result_key, defect, first, whole, expected, None if r.refused is None or pd.isna(r.refused) else bool(r.refused)))
            yield pd.DataFrame(out, columns=["answer_id", "question_id", "result_key", "defect", "opening", "whole", "expected", "refused"])

    checked = written(rows.mapInPandas(check, "answer_id string, question_id string, result_key string, defect string, opening string, whole double, expected boolean, refused boolean"), "answers")
    refusals = templates(checked.select("opening", F.col("question_id").alias("question_key"), "refused"))
    declines = F.col("template").isNotNull() & ~F.coalesce("expected", F.lit(False))
    cut = F.col("template").isNull() & (F.col("whole") < F.when(F.coalesce("cut", F.lit(False)), COMPLETE_IF_CUT).otherwise(COMPLETE))
    defect = (
        F.when(F.col("defect").isin("empty", "copied"), F.col("defect"))
        .when(declines, "refusal")
        .when(F.col("defect").isNotNull(), F.col("defect"))
        .when(cut, "truncated")
    )
    narrow = checked.select("answer_id", "result_key", "defect", "opening", "whole", "expected").where("defect is not null or whole < 1 or opening <> ''")
    return (
        narrow.join(refusals, "opening", "left")
        .where("defect is not null or template is not null or whole < 1")
        .join(ends, "result_key", "left")
        .withColumn("defect", defect)
        .where("defect is not null")
        .groupBy("answer_id")
        .agg(F.min("defect").alias("defect"))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "answers"), table(spark, sf_dir, "eval_set"), table(spark, sf_dir, "llm_results"))


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
