"""Problem 5: text that looks regular but is written with other characters.

Around every character that can be a look-alike, an ignorable or an odd space a unit is cut out: the word, or in Chinese text
one character on either side. Units are looked up in tries of the vocabulary (the words, and pairs and triples of
Chinese characters, of the rows without any candidate). The lookup walks the trie with a weighted edit automaton: replacing a look-alike
by what it looks like and dropping an ignorable cost nothing, another case or accent costs one, any other edit ends the
walk. The cheapest word, then the most frequent, is canonical; where the walk changed anything at no cost the unit is
irregular, and what it paid for stays as it was written. Units without a match are judged and normalised by table.

Units and words meet in shards by the hash of their skeleton (what all spellings at no more than those costs share), so that
no shard grows with a frequent beginning, no trie is broadcast, and only words that some unit can reach are in a trie.
Rows without any candidate character (nearly all) leave in the scan stage by a regular expression.

A character is irregular if it is invisible (a joiner inside an emoji is not), a space other than U+0020 and U+3000, a
detached accent, a full-width or otherwise styled letter or digit, another dot for the middle dot, a radical or
compatibility form of a CJK character, or a Greek or Cyrillic letter that stands for a Latin one: in a word with Latin
letters, in a code with digits, or in a word made only of look-alikes that the vocabulary knows in Latin letters.

Edge cases: null and empty texts are regular; repeated rows give one row; a token of ignorables only becomes empty; without
vocabulary the table decides alone; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans import written
from quillgraph.sources import table

#: Greek and Cyrillic letters and, at the same place, the Latin ones they look like.
FOREIGN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοАВЕЅІЈКМНОРСТУХаеорсухіјѕԁԛԝһӏ"
LATIN = "ABEZHIKMNOPTYXvoABESIJKMHOPCTYXaeopcyxijsdqwhl"
TWIN = dict(zip(FOREIGN, LATIN, strict=True))
#: Dots that stand for the middle dot.
DOTS = "\u00b7\u0387\u2027\u22c5\u2219\u30fb\uff65\u16eb\u2e31"

IGNORABLE = "\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u2028-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f"
STYLED = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\ufb00-\ufb06\u2e80-\u2ef3\u2f00-\u2fd5\uf900-\ufaff\uff61-\uff9f"
#: Unified although they stand among the compatibility forms.
UNIFIED = frozenset("\ufa0e\ufa0f\ufa11\ufa13\ufa14\ufa1f\ufa21\ufa23\ufa24\ufa27\ufa28\ufa29")
MARKS = "\u0300-\u036f"
GREEK_CYRILLIC = "\u0370-\u03ff\u0400-\u052f"
#: Above the basic plane: mathematical letters and digits, compatibility ideographs.
HIGH = "\U0001d400-\U0001d7ff\U0002f800-\U0002fa1d"
#: Dots for the middle dot, without itself.
OTHER_DOTS = DOTS.replace("\u00b7", "")

CANDIDATE = f"[{IGNORABLE}{SPACES}{STYLED}{MARKS}{GREEK_CYRILLIC}{HIGH}{OTHER_DOTS}]"
#: What a token consists of: letters, digits, marks, ignorables, and signs inside a word.
TOKEN = re.compile(f"(?:[^\\W_]|[{IGNORABLE}{MARKS}{STYLED}{HIGH}]|(?<=\\w)[-’'.](?=\\w))+|[{SPACES}{OTHER_DOTS}]")
IS_CANDIDATE = re.compile(CANDIDATE)
IS_IGNORABLE = re.compile(f"[{IGNORABLE}]")
WORD = "[A-Za-zÀ-ɏ0-9](?:[A-Za-zÀ-ɏ0-9]|[-’'.](?=[A-Za-zÀ-ɏ0-9]))+"
HAN = "[\u3400-\u9fff]{2,}"
IS_HAN = re.compile("[\u3400-\u9fff]")
#: Most that a walk may pay for other cases and accents, and units of one shard.
BUDGET, SHARD = 2, 20_000


def _is_emoji(c: str) -> bool:
    return "←" <= c <= "⯿" or "\U0001f000" <= c <= "\U0001faff"


def _joins_emoji(text: str, at: int) -> bool:
    """Whether the ignorable at `at` is part of an emoji."""
    before = at > 0 and (_is_emoji(text[at - 1]) or text[at - 1] == "\ufe0f")
    if text[at] == "\u200d":
        return before and at + 1 < len(text) and _is_emoji(text[at + 1])
    return text[at] == "\ufe0f" and before


def by_table(token: str) -> str:
    """The regular form of a token without a look at the vocabulary."""
    out = []
    for c in token:
        if IS_IGNORABLE.match(c):
            continue
        if c in DOTS:
            c = "·"
        elif unicodedata.category(c) == "Zs":
            c = c if c in " \u3000" else " "
        elif c in UNIFIED:
            pass
        elif IS_CANDIDATE.match(c):
            c = TWIN.get(c) or unicodedata.normalize("NFKC", c)
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def _letters(token: str) -> tuple[bool, bool, bool, bool]:
    """Whether a token has Latin letters, Greek or Cyrillic ones, only look-alikes among these, digits."""
    latin = foreign = digits = False
    twins = True
    for c in token:
        if "Ͱ" <= c <= "ԯ" and c not in DOTS:
            foreign = True
            twins = twins and c in TWIN
        elif c.isalpha() and unicodedata.normalize("NFKD", c)[0].isascii():
            latin = True
        elif c.isascii() and c.isdigit() or "０" <= c <= "９":
            digits = True
    return latin, foreign, twins, digits


def plain_verdict(token: str) -> bool | None:
    """True: irregular; False: regular; None: the vocabulary decides."""
    rest = "".join(c for c in token if not "Ͱ" <= c <= "ԯ" or c in DOTS)
    if any(IS_CANDIDATE.match(c) and c not in UNIFIED for c in rest):
        return True
    latin, foreign, twins, digits = _letters(token)
    if not foreign:
        return False
    if latin or (twins and digits):
        return True
    if not twins:
        return False
    return True if len(token) == 1 and "Ѐ" <= token else None


def likeness(c: str) -> str:
    """What a character looks like, itself if it is regular."""
    if c in OTHER_DOTS:
        return "·"
    if unicodedata.category(c) == "Zs":
        return " "
    return c if c in UNIFIED or not IS_CANDIDATE.match(c) else TWIN.get(c) or unicodedata.normalize("NFKC", c)


def skeleton(text: str) -> str:
    """What a text shares with all that it can be taken for: without case, accents, ignorables."""
    if text.isascii():
        return text.lower()
    plain = "".join(likeness(c) for c in text if not IS_IGNORABLE.match(c))
    return "".join(c for c in unicodedata.normalize("NFD", plain.lower()) if not unicodedata.combining(c))


def _base(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0].lower()


class Trie:
    """Words with their frequencies, walked by an automaton with free look-alikes and ignorables."""

    def __init__(self, words: Iterator[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = max(n, node.get("", 0))

    def match(self, token: str) -> tuple[str, str] | None:
        """The word that a token can be taken for at the least cost (then the most frequent), and the token's regular form."""
        states: list[tuple[int, dict, str, str]] = [(0, self.root, "", "")]
        for c in unicodedata.normalize("NFC", "".join(x for x in token if not IS_IGNORABLE.match(x))):
            like = likeness(c)
            free, base = (c, like), _base(like)
            grown = []
            for cost, node, word, out in states:
                for x, below in node.items():
                    if x in free and x:
                        grown.append((cost, below, word + x, out + x))
                    elif x and cost < BUDGET and _base(x) == base:
                        grown.append((cost + 1, below, word + x, out + by_table(c)))
            states = grown
            if not states:
                return None
        ends = [(cost, -node[""], word, out) for cost, node, word, out in states if "" in node]
        return min(ends)[2:] if ends else None


def odd_tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of the tokens with a candidate character that isn't part of an emoji."""
    out = []
    for m in TOKEN.finditer(text):
        if IS_CANDIDATE.search(m.group()):
            if all(_joins_emoji(text, m.start() + k) for k, c in enumerate(m.group()) if IS_CANDIDATE.match(c)):
                continue
            out.append((m.start(), m.end(), m.group()))
    return out


def units(token: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a token around its candidates: words, or a Chinese character on either side."""
    out: list[list[int]] = []
    for m in re.finditer(f"{CANDIDATE}+", token):
        start, end = m.span()
        letters = all(c.isalnum() and not IS_HAN.match(unicodedata.normalize("NFKC", c)[:1]) for c in m.group() if not IS_IGNORABLE.match(c))
        alone = not any(not IS_IGNORABLE.match(c) and not unicodedata.combining(c) for c in m.group())
        for step in (-1, 1):
            at = start - 1 if step < 0 else end
            if 0 <= at < len(token) and IS_HAN.match(token[at]):
                if alone or not letters:
                    start, end = (at, end) if step < 0 else (start, at + 1)
                continue
            while 0 <= at < len(token) and not IS_HAN.match(token[at]):
                at += step
            start, end = (at + 1, end) if step < 0 else (start, at)
        if out and start < out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def regularised(rows: DataFrame) -> DataFrame:
    """rows(table_name, record_id, text) -> the affected rows with `regular`, their text in the one regular form, the number
    of irregular units and of those that the walk decided."""
    rows = rows.select("table_name", "record_id", "text")
    suspects = rows.where(F.col("text").rlike(CANDIDATE)).dropDuplicates()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (t, i, text, at + a, at + b, token[a:b], plain_verdict(token))
                for t, i, text in zip(batch["table_name"], batch["record_id"], batch["text"], strict=True)
                for at, _, token in odd_tokens(text)
                for a, b in units(token)
            ]
            yield pd.DataFrame(out, columns=["table_name", "record_id", "text", "at", "end", "unit", "verdict"])

    def with_skeleton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(skeleton=[skeleton(x) for x in batch.iloc[:, 0]])

    found = suspects.mapInPandas(cut, "table_name string, record_id string, text string, at int, end int, unit string, verdict boolean")
    odd = written(found.select("unit").distinct().mapInPandas(with_skeleton, "unit string, skeleton string"), "units")
    runs = F.regexp_extract_all("text", F.lit(HAN), F.lit(0))
    parts = lambda run, n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.flatten(F.transform(runs, lambda r: F.concat(parts(r, 2), parts(r, 3)))))
    words = (
        rows.where((F.col("text") != "") & ~F.col("text").rlike(CANDIDATE)).select(F.explode(pieces).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        .mapInPandas(with_skeleton, "word string, n long, skeleton string")
        .join(odd.select("skeleton").distinct(), "skeleton", "left_semi")
    )
    shard = F.pmod(F.xxhash64("skeleton"), F.lit(max(1, -(-odd.count() // SHARD)))).alias("shard")

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(zip(right["word"], right["n"], strict=True))
        found = [trie.match(t) for t in left["unit"]]
        return pd.DataFrame({"unit": left["unit"], "form": [m and m[1] for m in found]})

    matched = odd.select("unit", shard).groupBy("shard").cogroup(words.select("word", "n", shard).groupBy("shard")).applyInPandas(match, "unit string, form string")

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, i, text, parts in zip(batch["table_name"], batch["record_id"], batch["text"], batch["parts"], strict=True):
                regular, bad, walked = text, 0, 0
                for p in sorted(parts, key=lambda p: -p["at"]):
                    walk = p["form"] is not None and p["form"] != p["unit"]
                    if walk or p["verdict"]:
                        bad, walked = bad + 1, walked + walk
                        regular = regular[: p["at"]] + (p["form"] if walk else by_table(p["unit"])) + regular[p["end"] :]
                if bad:
                    out.append((t, i, text, unicodedata.normalize("NFC", regular), bad, walked))
            yield pd.DataFrame(out, columns=["table_name", "record_id", "text", "regular", "units", "walked"])

    return (
        found.join(matched, "unit", "left")
        .groupBy("table_name", "record_id", "text")
        .agg(F.collect_list(F.struct("at", "end", "unit", "form", "verdict")).alias("parts"))
        .mapInPandas(rebuild, "table_name string, record_id string, text string, regular string, units int, walked int")
    )


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(key).alias("record_id"), F.col(field).alias("text"))
        for name, key, field in (("entities", "id", "name"), ("triples", "triple_id", "evidence"), ("answers", "answer_id", "text"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularised(_rows(spark, sf_dir)).select("table_name", "record_id").distinct()


def p5_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularised(_rows(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_regular": p5_regular}
SQL: dict[str, str] = {}
