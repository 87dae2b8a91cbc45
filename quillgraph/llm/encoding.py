"""Problem 9: text that was decoded with the wrong character encoding.

A chain (seen, true) says: the bytes were in `true` but were decoded as `seen`. For every chain the text is encoded
again with `seen` and each stretch of bytes that is well-formed in `true` becomes a candidate. A candidate is accepted
if a smoothed character bigram model, trained on the clean records of the same table, finds the decoded stretch likelier
than what stands there, by a margin per character and a validated margin in total; the likeliest chain wins, and the
result is tried once more (text garbled twice). Between two single-byte encodings a stretch may be one letter, so there the
gains of all stretches of a text are added up, and one chain explains the text. Characters lost for good (U+FFFD) stay
lost; a text in which a run of them stands beside other debris counts as affected even if nothing can be restored.

A chain is left out for a text only if it can't apply: masks made from the code tables say whether any stretch of the text
is well-formed, and chains that are well-formed everywhere (between two double-byte or two single-byte encodings) need a
stretch, or a sign, that the model finds implausible. The margin is the least of `MARGINS` that changes hardly any of all clean
records of the table (`validated`); `fitted_margin` reports the recall on some of them garbled on purpose.

Two passes over the text: one trains (counts are summed per partition before the shuffle; the model is an array of fixed
size, `BUCKETS` floats), one scores; each margin that changes too many clean records costs another. All are Arrow batches;
texts are never shuffled.

Edge cases: null and empty texts are never affected; the result has one row per doc_id and text, repeated rows collapse;
without any clean record the model is flat and only damage marks count; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans import written
from quillgraph.sources import table

#: Size of the hashed bigram table and of the character table: the proven bound of what is collected and broadcast.
BUCKETS, CHARS = 1 << 20, 1 << 16
#: Weight of the character model in the bigram model.
BACKOFF = 2.0
#: Least gain in mean log likelihood per character, and the gains in total that may be the validated margin.
MARGIN_MEAN, MARGINS = 1.0, (8.0, 10.0, 12.0, 16.0)
#: Least gain of a whole text between two single-byte encodings, as a multiple of the margin.
LETTERS = 1.75
#: The share of all clean records that the validated margin may change.
CHANGED = 0.01
#: A stretch of at least this mean is plausible as it stands; a window under the other is not.
PLAUSIBLE, IMPLAUSIBLE, WINDOW = -5.5, -8.5, 6
#: A single letter under this is unlikely where it stands.
UNLIKELY = -9.0
#: Signs other than CJK under this share of all characters are unknown to the model (damage can't teach it itself).
RARE = 2e-5
LOST = "�"

SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850")
MULTI = ("gb18030", "big5", "cp932", "cp949")
#: True encodings of stretches that may be one letter.
WESTERN = ("cp1252", "mac_roman", "cp850")
PATTERNED = (
    [(e, "utf-8") for e in SINGLE + MULTI]
    + [(e, t) for e in ("cp1252", "latin-1") for t in ("gb18030", "big5", "cp932", "cp949", "euc_jp")]
    + [(e, t) for e in SINGLE for t in ("cp1251", "koi8-r") if e != t]
)
DOUBLE = [(e, t) for e in MULTI for t in MULTI if e != t]
LETTERED = [(e, t) for e in SINGLE for t in WESTERN if e != t]
CHAINS = PATTERNED + DOUBLE + LETTERED

UTF8 = rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})"
#: Well-formed stretches of each true encoding; NUL stands for what can't be encoded, \x01 for a lost character.
STRETCH = {
    "utf-8": re.compile(UTF8 + rb"(?:" + UTF8 + rb"|[\x80-\xff]?[\x80-\xbf]?\x01{1,8}[\x80-\xbf]{0,2}(?=" + UTF8 + rb"))*"),
    "gb18030": re.compile(rb"(?:[\x81-\xfe][\x40-\x7e\x80-\xfe]){2,}"),
    "big5": re.compile(rb"(?:[\x81-\xfe][\x40-\x7e\xa1-\xfe]){2,}"),
    "cp932": re.compile(rb"(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]){2,}"),
    "cp949": re.compile(rb"(?:[\x81-\xfe][\x41-\x5a\x61-\x7a\x81-\xfe]){2,}"),
    "euc_jp": re.compile(rb"(?:[\xa1-\xfe]{2}){2,}"),
    "koi8-r": re.compile(rb"[\xc0-\xff]{3,}"),
    "cp1251": re.compile(rb"[\xc0-\xff]{3,}"),
} | {t: re.compile(rb"[\x80-\xff]+") for t in WESTERN}
#: In half-width signs a single pair can be told.
HALF = re.compile(rb"(?:[\xa1-\xfe][\xa1-\xfe])+")
RUN = re.compile(rb"(?:[\xe2-\xe9\xef][\x80-\xbf]{2}){2}")
#: Text that was garbled twice still shows a lead and a continuation character after one repair.
TWICE = re.compile("[Â-ô][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]")
TWICE_CHAINS = [("cp1252", "utf-8"), ("latin-1", "utf-8")]
DEBRIS = re.compile("[\x80-\x84\x86-\x9f\ue000-\uf8ff�]")


@lru_cache(maxsize=16)
def _lookup(name: str) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the basic plane its bytes in an encoding (padded to 4) and their number.

    Bytes that a single-byte encoding leaves open stand for themselves. A lost character is \\x01; in gb18030 it is
    \\x80, the one byte that never begins a character there.
    """
    data, lengths = np.zeros((CHARS, 4), np.uint8), np.ones(CHARS, np.uint8)
    if name in SINGLE:
        for b in range(255, -1, -1):
            try:
                data[ord(bytes([b]).decode(name)), 0] = b
            except UnicodeDecodeError:
                data[b, 0] = b
    else:
        for c in range(CHARS):
            try:
                raw = chr(c).encode(name)
                data[c, : len(raw)] = list(raw)
                lengths[c] = len(raw)
            except UnicodeEncodeError:
                pass
    data[0xFFFD], lengths[0xFFFD] = 0, 1
    data[0xFFFD, 0] = 0x80 if name == "gb18030" else 1
    return data, lengths


def encoded(c: np.ndarray, seen: str) -> tuple[np.ndarray | None, bytes]:
    """The bytes of a text in `seen`, and for each the character that it comes from (None: one byte each)."""
    table_, lengths = _lookup(seen)
    if seen in SINGLE:
        return None, table_[c, 0].tobytes()
    n = lengths[c]
    return np.repeat(np.arange(len(c)), n), table_[c][np.arange(4) < n[:, None]].tobytes()


def stretches(where: np.ndarray | None, data: bytes, pattern: re.Pattern, wanted: Callable[[int, int], bool]) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of each wanted stretch of an encoded text."""
    for m in pattern.finditer(data):
        a, b = m.span()
        if where is not None:
            a, b = int(where[a]), int(where[b - 1]) + 1
            if wanted(a, b):
                low, high = np.searchsorted(where, [a, b])
                yield a, b, data[low:high]
        elif wanted(a, b):
            yield a, b, m.group()


class Model:
    """Smoothed character bigrams in arrays of fixed size; records: how many texts they come from."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray, records: int = 0):
        self.records = records
        total = chars.sum()
        self.chars = ((chars + 0.05) / (total + 0.05 * CHARS)).astype(np.float32)
        self.counts, self.pairs = chars.astype(np.float32), pairs.astype(np.float32)
        self.rare = (chars < RARE * total) & _signs()

    def each(self, text: str) -> np.ndarray:
        """The log likelihood of each character after its predecessor."""
        c = codes(text)
        first, second = c[:-1] & (CHARS - 1), c[1:] & (CHARS - 1)
        p = (self.pairs[hashed(c)] + BACKOFF * self.chars[second]) / (self.counts[first] + BACKOFF)
        p = np.where(self.rare[first], self.chars[second], p)
        bad = (second == 0xFFFD) | ((second >= 0x80) & (second < 0xA0)) | ((second >= 0xE000) & (second < 0xF900))
        return np.where(bad, -16.0, np.where(self.rare[second], -12.0, np.log(p)))


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """Letters and signs that aren't CJK, Hangul or ASCII."""
    own = np.ones(CHARS, bool)
    for low, high in ((0, 0x7F), (0x2E80, 0xD7FF), (0xF900, 0xFAFF)):
        own[low : high + 1] = False
    return own


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def hashed(c: np.ndarray) -> np.ndarray:
    h = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


#: Characters of a batch that are looked at in one go.
SLICE = 1 << 19
#: Places of the eight bits over `SINGLE`, and of the four bits over `MULTI`, in the masks of a character.
LEAD2, SURE2, LEAD3, LEAD4, NEXT, HIGH, LETTER = range(0, 56, 8)
LN, NL, NN, XL, NX, TWO = range(0, 24, 4)
ODD = 1 << 24


@lru_cache(maxsize=1)
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For each character what its byte can be in the single-byte encodings, and what its two bytes are in the others.

    The two bytes are read as UTF-8: l leads three bytes, n follows, x is any. `ODD` marks signs that are damage or stand
    alone in the scripts of these tables.
    """
    single, multi = np.zeros(CHARS, np.uint64), np.zeros(CHARS, np.uint32)
    marks = np.array([unicodedata.category(chr(c))[0] == "P" for c in range(CHARS)])
    for bit, name in enumerate(SINGLE):
        data = _lookup(name)[0][:, 0]
        known = np.zeros(CHARS, bool)
        known[[ord(bytes([b]).decode(name, "ignore") or chr(b)) for b in range(128, 256)]] = True
        for key, low, high in ((LEAD2, 0xC2, 0xDB), (LEAD3, 0xE0, 0xEF), (LEAD4, 0xF0, 0xF4), (NEXT, 0x80, 0xBF), (HIGH, 0x81, 0xFE), (LETTER, 0xC0, 0xFF)):
            single |= ((data >= low) & (data <= high) & known).astype(np.uint64) << np.uint64(key + bit)
        single |= ((data >= 0xC2) & (data <= 0xDB) & known & ~marks).astype(np.uint64) << np.uint64(SURE2 + bit)
    for bit, name in enumerate(MULTI):
        data, lengths = _lookup(name)
        first, second, pair = data[:, 0], data[:, 1], lengths == 2
        lead = lambda b: ((b >= 0xE2) & (b <= 0xE9)) | (b == 0xEF)
        follow = lambda b: (b >= 0x80) & (b <= 0xBF)
        two = (first >= 0xC2) & (first <= 0xCB) & follow(second)
        for key, mask in ((LN, lead(first) & follow(second)), (NL, follow(first) & lead(second)), (NN, follow(first) & follow(second)), (XL, lead(second)), (NX, follow(first)), (TWO, two)):
            multi |= (mask & pair).astype(np.uint32) << np.uint32(key + bit)
    for low, high in ((0x80, 0x84), (0x86, 0x9F), (0xE000, 0xF8FF), (0xAC00, 0xD7A3), (0xFF61, 0xFF9F), (0xFFFD, 0xFFFD)):
        multi[low : high + 1] |= np.uint32(ODD)
    return single, multi


HALF_WIDTH = re.compile("[\uff61-\uff9f]")


def clues(c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text, which begin at `starts` in c and end before a sign that can't be encoded: bits of the single-byte
    encodings in which characters hold UTF-8, four high bytes in a row, three letters in a row; bits of the double-byte ones
    in which they hold two sequences of UTF-8, or a short one beside a Latin letter; whether a sign is odd, or lost.
    """
    single, multi = _masks()[0][c], _masks()[1][c]

    def of(mask: np.ndarray, place: int, shift: int = 0) -> np.ndarray:
        own = (mask >> mask.dtype.type(place)).astype(np.uint8)
        return own[shift:] if shift else own

    def per_text(own: np.ndarray) -> np.ndarray:
        return np.bitwise_or.reduceat(np.concatenate([own, np.zeros(len(c) - len(own), own.dtype)]), starts)

    if len(c) < 4:
        nothing = np.zeros(len(starts), np.uint8)
        return nothing, nothing, nothing, nothing, per_text((multi & np.uint32(ODD)) > 0), per_text(c == 0xFFFD)
    follow, high, letter = of(single, NEXT), of(single, HIGH), of(single, LETTER)
    # a lead that is a common mark of punctuation counts only in two sequences
    two = of(single, LEAD2)[:-1] & follow[1:]
    utf8 = of(single, SURE2)[:-1] & follow[1:]
    utf8[:-2] |= two[:-2] & two[2:]
    utf8[:-1] |= of(single, LEAD3)[:-2] & follow[1:-1] & follow[2:]
    utf8[:-2] |= of(single, LEAD4)[:-3] & follow[1:-2] & follow[2:-1] & follow[3:]
    pairs = high[:-3] & high[1:-2] & high[2:-1] & high[3:]
    letters = letter[:-2] & letter[1:-1] & letter[2:]
    four = np.uint8(15)
    nn, short, ln = of(multi, NN), of(multi, TWO) & four, of(multi, LN)
    held = np.zeros(len(c), np.uint8)
    held[:-2] |= ln[:-2] & of(multi, NL)[1:-1] & nn[2:]
    held[:-3] |= of(multi, XL)[:-3] & nn[1:-2] & ln[2:-1] & of(multi, NX)[3:]
    latin = ((c | 32) >= 97) & ((c | 32) <= 122)
    held[:-1] |= np.where(latin[1:], short[:-1], 0).astype(np.uint8)
    held[1:] |= np.where(latin[:-1], short[1:], 0).astype(np.uint8)
    return per_text(utf8), per_text(pairs), per_text(letters), per_text(held & four), per_text((multi & np.uint32(ODD)) > 0), per_text(c == 0xFFFD)


def joined(texts: list[str]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """Slices of texts: index of the first, all texts with a line before and after each, their characters, their starts."""
    sizes = np.cumsum([len(t) + 1 for t in texts])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist(), len(texts)] if len(texts) else []
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = texts[low:high]
        text = "\n" + "\n".join(own) + "\n"
        starts = np.cumsum([1] + [len(t) + 1 for t in own[:-1]])
        c = codes(text)
        yield low, text, np.where(c < CHARS, c, 0), starts


def suspicions(texts: list[str]) -> np.ndarray:
    """Whether a stretch of each text is well-formed in another encoding; other texts may train the model.

    What was garbled by a double-byte encoding other than gb18030 holds kana, Hangul or lost characters, for those
    encodings leave the continuation byte 0x80 open.
    """
    out = np.zeros(len(texts), bool)
    for low, _, c, starts in joined(texts):
        utf8, pairs, _, multi, odd, _ = clues(c, starts)
        own = (utf8 > 0) | ((pairs & 3) > 0) | odd
        for k in np.flatnonzero(~own & ((multi & 1) > 0)):
            own[k] = bool(RUN.search(texts[low + k].encode("gb18030", "ignore")))
        out[low : low + len(own)] = own
    return out


def suspicious(text: str) -> bool:
    return bool(suspicions([text])[0])


def train(texts: DataFrame) -> Model:
    """The model of the clean records of texts(text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, chars, records = np.zeros(BUCKETS, np.int64), np.zeros(CHARS, np.int64), np.zeros(1, np.int64)
        for batch in batches:
            texts = [t for t in batch["text"] if t]
            clean = [t for t, bad in zip(texts, suspicions(texts), strict=True) if not bad]
            records += len(clean)
            c = codes("\n" + "\n".join(clean) + "\n")
            pairs += np.bincount(hashed(c), minlength=BUCKETS)
            chars += np.bincount(c[:-1] & (CHARS - 1), minlength=CHARS)
        for kind, counts in ((0, pairs), (1, chars), (2, records)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": np.int32(kind), "at": at.astype(np.int32), "n": counts[at]})

    rows = (
        texts.select("text")
        .mapInPandas(count, "kind int, at int, n long")
        .groupBy("kind", "at")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    arrays = []
    for kind, size in ((0, BUCKETS), (1, CHARS)):
        own = rows[rows["kind"] == kind]
        counts = np.zeros(size)
        counts[own["at"].to_numpy()] = own["n"].to_numpy()
        arrays.append(counts)
    return Model(*arrays, int(rows.loc[rows["kind"] == 2, "n"].sum()))


def unlikely_signs(c: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Where a sign or letter beyond ASCII and CJK stands that the model doesn't expect."""
    return (each[: len(c)] < UNLIKELY) & _signs()[c]


def chains_for(text: str, c: np.ndarray, each: np.ndarray) -> list[list[tuple[str, str]]]:
    """The chains that can apply to a text with the log likelihoods `each`, by how telling their byte patterns are."""
    utf8, pairs, letters, multi, odd, lost = (int(x[0]) for x in clues(np.append(c, 0), np.zeros(1, np.int64)))
    run, strict = np.cumsum(each), []
    for seen, true in PATTERNED:
        if seen in MULTI:
            bits, bit = multi, 1 << MULTI.index(seen)
        else:
            bits, bit = utf8 if true == "utf-8" else letters if true in ("cp1251", "koi8-r") else pairs, 1 << SINGLE.index(seen)
        if bits & bit or (lost and seen in MULTI):
            strict.append((seen, true))
    strange = bool(odd) or (len(run) > WINDOW and float((run[WINDOW:] - run[:-WINDOW]).min()) < WINDOW * IMPLAUSIBLE)
    signs = unlikely_signs(c, each)
    lettered = []
    if signs.any():
        high = (_masks()[0][c[signs]] >> np.uint64(HIGH)).astype(np.int64)
        able = [e for k, e in enumerate(SINGLE) if (high >> k & 1).mean() >= 0.5]
        lettered = [(e, t) for e, t in LETTERED if e in able]
    return [strict, DOUBLE if strange else [], lettered]


def candidates(texts: list[str], model: Model) -> list[int]:
    """The texts to which any chain can apply, told for many in one go (a window may also lie across two of them)."""
    out = []
    for low, text, c, starts in joined(texts):
        utf8, pairs, letters, multi, odd, lost = clues(c, starts)
        each = np.append(model.each(text), 0.0)
        run = np.cumsum(np.concatenate([[0.0], each]))
        window = (run[WINDOW:] - run[:-WINDOW] < WINDOW * IMPLAUSIBLE).astype(np.uint8)
        strange = np.bitwise_or.reduceat(np.concatenate([window, np.zeros(len(c) - len(window), np.uint8)]) if len(window) < len(c) else window[: len(c)], starts - 1)
        signs = np.bitwise_or.reduceat(((np.concatenate([[0.0], each[:-1]]) < UNLIKELY) & _signs()[c]).astype(np.uint8), starts)
        own = (utf8 > 0) | ((pairs & 3) > 0) | (letters > 0) | (multi > 0) | odd | lost | (strange > 0) | (signs > 0)
        out += (np.flatnonzero(own) + low).tolist()
    return out


def restore(text: str, model: Model, chains: list[tuple[str, str]] | None = None, depth: int = 2, margin: float = MARGINS[0]) -> tuple[str, list[str], int]:
    """The restored text, the chains used and the number of stretches.

    Chains whose bytes are well-formed everywhere are tried where those with a telling pattern restore nothing.
    """
    if len(text) < 2 or text.isascii():
        return text, [], 0
    each = model.each("\n" + text + "\n")
    c = codes(text)
    c = np.where(c < CHARS, c, 0)
    for own in chains_for(text, c, each) if chains is None else [chains]:
        if own:
            out = _restore(text, c, each, model, own, depth, margin)
            if out[2]:
                return out
    return text, [], 0


def _restore(text: str, c: np.ndarray, each: np.ndarray, model: Model, chains: list[tuple[str, str]], depth: int, margin: float) -> tuple[str, list[str], int]:
    sums = np.concatenate([[0.0], np.cumsum(each)]).tolist()
    signs = unlikely_signs(c, each)
    tried, seen_before = [], set()

    def implausible(a: int, b: int) -> bool:
        old = sums[b + 1] - sums[a]
        return old <= -margin and old <= PLAUSIBLE * (b + 1 - a)

    def of_letters(a: int, b: int) -> bool:
        return implausible(a, b) and bool(signs[a:b].any())

    data: dict[str, tuple[np.ndarray | None, bytes]] = {}
    for seen, true in chains:
        if seen not in data:
            data[seen] = encoded(c, seen)
        pattern = HALF if (seen, true) == ("cp932", "gb18030") and HALF_WIDTH.search(text) else STRETCH[true]
        for a, b, raw in stretches(*data[seen], pattern, of_letters if true in WESTERN else implausible):
            old, n = sums[b + 1] - sums[a], b + 1 - a
            decoded = raw.replace(b"\x01", b"\xff").decode(true, "replace")
            if LOST in decoded:
                decoded = re.sub(LOST + "+", LOST, decoded)
            chain = f"{seen}<{true}"
            if depth > 1 and seen in SINGLE and true == "utf-8" and TWICE.search(decoded):
                before, after = text[max(0, a - 1) : a], text[b : b + 1]
                decoded, more, times = restore(before + decoded + after, model, TWICE_CHAINS, depth - 1, margin)
                decoded = decoded[len(before) : len(decoded) - len(after)]
                if times:
                    chain += "<<" + more[0]
            # letters are added up by chain, so there each chain keeps its own
            key = (a, b, decoded, chain if true in WESTERN else "")
            if key not in seen_before and not (len(decoded) < 3 and DEBRIS.search(decoded)):
                seen_before.add(key)
                tried.append((a, b, decoded, chain, old, n, true))
    if not tried:
        return text, [], 0
    own = [(text[a - 1] if a else "\n") + decoded + text[b : b + 1] for a, b, decoded, *_ in tried]
    starts = np.cumsum([0] + [len(x) for x in own]).tolist()
    whole = "".join(own)
    scores = np.concatenate([[0.0], np.cumsum(model.each(whole))]).tolist()
    unknown = np.concatenate([[0], np.cumsum(model.rare[codes(whole) & (CHARS - 1)])]).tolist()
    found, letters = [], {}
    for k, (a, b, decoded, chain, old, n, true) in enumerate(tried):
        begin = starts[k] + 1
        if true != "utf-8" and unknown[begin + len(decoded)] > unknown[begin]:
            continue
        new, m = scores[starts[k + 1] - 1] - scores[starts[k]], len(own[k]) - 1
        if new / m - old / n <= MARGIN_MEAN or (len(decoded) <= 2 and not (model.pairs[hashed(codes(own[k]))] > 0).any()):
            continue
        if true in WESTERN:
            letters.setdefault(chain, []).append((new - old, a, b, decoded, chain))
        elif new - old > margin:
            found.append((new - old, a, b, decoded, chain))
    if letters:
        best = max(letters.values(), key=lambda rows: (sum(r[0] for r in rows), rows[0][4]))
        if sum(r[0] for r in best) > LETTERS * margin:
            found += best
    used: list[str] = []
    taken: list[tuple[int, int, str]] = []
    for _, a, b, decoded, chain in sorted(found, key=lambda x: (-x[0], x[1], x[4])):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, decoded))
            if chain not in used:
                used.append(chain)
    for a, b, decoded in sorted(taken, reverse=True):
        text = text[:a] + decoded + text[b:]
    return text, used, len(taken)


def garbled(text: str, seen: str, true: str) -> str | None:
    """A text whose bytes in `true` are decoded as `seen`; None if that isn't possible or changes nothing."""
    try:
        out = text.encode(true).decode(seen)
    except UnicodeError:
        return None
    return None if out == text else out


def fitted_margin(model: Model, texts: list[str]) -> tuple[float, float, float]:
    """The least of `MARGINS` that changes hardly any of some clean texts, the share that it changes, its recall on them garbled."""
    clean = [t for t in texts if t and not suspicious(t)]
    for margin in MARGINS:
        changed = sum(bool(restore(t, model, margin=margin)[2]) for t in clean) / max(1, len(clean))
        if changed <= CHANGED:
            break
    bad = [g for k, t in enumerate(clean) if (g := garbled(t, *CHAINS[k % len(CHAINS)]))]
    return margin, changed, sum(bool(restore(t, model, margin=margin)[2]) for t in bad) / max(1, len(bad))


def judged(documents: DataFrame, model: Model, margin: float) -> DataFrame:
    """The rows of `mend`, and whether each counts as clean."""
    shared = documents.sparkSession.sparkContext.broadcast((model.pairs, model.counts))
    schema = "doc_id long, chains string, stretches int, whole boolean, restored string, clean boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for batch in batches:
            rows, texts, keys = [], [t or "" for t in batch["text"]], batch["doc_id"].to_numpy()
            for k in candidates(texts, own):
                key, text = keys[k], texts[k]
                restored, used, n = restore(text, own, margin=margin)
                if n or len(DEBRIS.findall(text)) >= 2:
                    rows.append((key, ",".join(used), n, not DEBRIS.search(restored), restored, not suspicious(text)))
            yield pd.DataFrame(rows, columns=["doc_id", "chains", "stretches", "whole", "restored", "clean"])

    return documents.select("doc_id", "text").mapInPandas(run, schema)


def mend(documents: DataFrame, model: Model, margin: float = MARGINS[0]) -> DataFrame:
    """documents(doc_id, text) -> the affected rows: doc_id, chains, stretches, whole (nothing stays lost), restored."""
    return judged(documents, model, margin).drop("clean")


def validated(documents: DataFrame, model: Model) -> DataFrame:
    """`mend` with the least of `MARGINS` that changes hardly any of the clean records that the model is trained on.

    The changes are counted in the result itself, which is computed once if the first margin holds.
    """
    for margin in MARGINS:
        out = written(judged(documents, model, margin), "mended")
        if out.where("clean and stretches > 0").count() <= CHANGED * model.records:
            break
    return out.drop("clean")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return validated(documents, train(documents))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_restored(spark, sf_dir).select("doc_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
SQL: dict[str, str] = {}
