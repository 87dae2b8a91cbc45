"""Problem 8: held-out passages inside the corpus, by a distributed positional inverted index.

Texts become streams of folded letters and digits (no spaces, punctuation, mark-up or footnote numbers). A term is a
window of the stream: `CJK_TERM` characters if it begins with a CJK character, `ALPHABETIC_TERM` otherwise.

1. Each held-out item may ask, in stretches, for those of its terms that few items share (for all, if most of its
   stretches have no such term).
2. In each stretch an item takes the rarest few of its terms that are present: rare among the items first, then in the
   corpus (counted over all documents, summed per task before the shuffle).
3. The index of the corpus is a stored table of postings (term, document, position) of the terms asked for, partitioned and
   sorted by term. A bit filter of fixed size (`FILTER` bits, built by an aggregation) is the one thing that is broadcast,
   whatever the size of the held-out side; nothing is collected. Postings are joined with the items' terms, offsets
   subtracted, so that a passage shows as weight on one diagonal, each hit weighing one by the number of items with its
   term. What remains of a hot term is split by the adaptive join.
4. Every heavy diagonal is matched with all terms of its document: exact phrases, and proximity (phrases on
   neighbouring diagonals, with small gaps), are joined into one passage, whose share of the item decides.

Edge cases: null and empty texts on either side give nothing; an item shorter than one term can't be found; equal items
are searched once; repeated rows give one row; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.text import PLANE, codes, signal
from quillgraph.plans import bounded_broadcast, written
from quillgraph.sources import table

CJK_TERM, ALPHABETIC_TERM = 4, 9
#: Characters of text that are turned into terms at a time.
SHARD = 1_000_000
#: Bits of the filter of asked terms, a power of two, and of one row of it: the proven bound of the broadcast.
FILTER, SLICE = 1 << 24, 1 << 15
#: Terms of an item are taken in stretches of this many; of each the rarest few are looked up first.
STRETCH, RAREST = 16, 4
#: Terms of more items than this are looked up only for items that have no rarer ones in half of their stretches.
RARE = 3
#: Asked terms up to this number are broadcast to the index; beyond, the join shuffles on the term.
SMALL = 500_000
#: Width of a diagonal bucket; weight and hits on it that make a candidate (weight: share of what a whole passage has).
WIDTH, HITS, WEIGHT = 64, 3, 0.12
#: Share of the item that one continuous passage must cover.
SHARE = 0.45
#: Longest gap inside a passage, as characters of the item's stream.
GAP = {True: 24, False: 60}

NOISE = re.compile(r"</?[A-Za-z][^<>]{0,40}>|\[\d{1,3}\]|&[a-z]{2,6};")


def stream(text: str) -> np.ndarray:
    """The folded letters and digits of a text."""
    if "[" in text or "<" in text or "&" in text:
        text = NOISE.sub(" ", text)
    c = codes(text)
    folded = signal()[0][np.minimum(c, PLANE - 1)]
    return folded[folded > 0]


def term_hashes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of a stream the hash of the term that begins there and the term's length."""
    n, cjk = len(s), signal()[1][s]
    x = s.astype(np.uint64)

    def rolled(k: int) -> np.ndarray:
        h = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            h = (h ^ x[j : n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    out, lengths = np.zeros(n, np.uint64), np.where(cjk, CJK_TERM, ALPHABETIC_TERM)
    for k, mask in ((CJK_TERM, cjk), (ALPHABETIC_TERM, ~cjk)):
        if n >= k:
            h, own = rolled(k), mask[: n - k + 1]
            out[: n - k + 1][own] = h[own] | np.uint64(1)
    return out, lengths


def passage(own: np.ndarray, lengths: np.ndarray, cjk: bool, every: np.ndarray, diagonal: int) -> tuple[float, int]:
    """Share of an item's terms `own` and characters covered by the best passage near a diagonal of a document's terms `every`."""
    band = WIDTH + len(own) // 6
    a, b = max(0, diagonal - band), min(len(every), diagonal + len(own) + band)
    if b <= a:
        return 0.0, 0
    off, pos = np.nonzero((own[:, None] == every[None, a:b]) & (own != 0)[:, None])
    near = np.abs(pos + a - off - diagonal) <= band
    off, pos = off[near], pos[near]
    if not len(off):
        return 0.0, 0
    # phrases: runs along one diagonal
    d = pos - off
    o = np.lexsort((off, d))
    off, d = off[o], d[o]
    cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(off) != 1)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(off)]])
    phrases = sorted((int(off[x]), int(off[y - 1] + lengths[off[y - 1]]), int(d[x])) for x, y in zip(starts, ends, strict=True))
    return chain(phrases, len(own), GAP[cjk])


def chain(phrases: list[tuple[int, int, int]], size: int, gap: int) -> tuple[float, int]:
    """Best chain of phrases, ordered by their begin, that advance in both texts with gaps of at most `gap` on either side."""
    best: list[int] = []
    top, longest = 0, max((b - a for a, b, _ in phrases), default=0)
    for k, (a, b, d) in enumerate(phrases):
        score = b - a
        for x in range(k - 1, -1, -1):
            a2, b2, d2 = phrases[x]
            if a - a2 > gap + longest:
                break
            if a - b2 > gap or a <= a2 or b <= b2:
                continue
            skipped = (a + d) - (b2 + d2)
            if -(b2 - a2) < skipped <= gap and abs(d - d2) <= gap:
                score = max(score, best[x] + b - max(a, b2))
        best.append(score)
        top = max(top, score)
    return top / size, top


def item_terms(items: DataFrame) -> DataFrame:
    """items(item, text) -> item, terms (0 where none begins), lengths, cjk: one row per item with a term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                s = stream(text)
                h, lengths = term_hashes(s)
                if np.count_nonzero(h):
                    rows.append((item, h.view(np.int64), lengths.astype(np.int32), bool(signal()[1][s].mean() > 0.5)))
            yield pd.DataFrame(rows, columns=["item", "terms", "lengths", "cjk"])

    return items.select("item", "text").mapInPandas(run, "item long, terms array<long>, lengths array<int>, cjk boolean")


def asked_filter(terms: DataFrame) -> np.ndarray:
    """terms(term) -> the bits of the terms, eight to a byte."""
    at = F.expr(f"shiftrightunsigned(term, 20) & {FILTER - 1}")
    rows = terms.select(at.alias("at")).groupBy(F.expr(f"at div {SLICE}").cast("int").alias("slice")).agg(F.expr(f"bitmap_construct_agg(at % {SLICE})").alias("bits")).collect()
    out = np.zeros(FILTER // 8, np.uint8)
    for r in rows:
        own = np.frombuffer(bytes(r.bits), np.uint8)[: SLICE // 8]
        out[r.slice * (SLICE // 8) : r.slice * (SLICE // 8) + len(own)] = own
    return out


def _hits(batch: pd.DataFrame, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(term, row of the batch, position) of the terms of a filter, for some texts at a time."""
    sizes = batch["text"].str.len().to_numpy()
    for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(np.cumsum(sizes) // SHARD)) + 1):
        streams = [stream(t) for t in batch["text"].iloc[part]]
        n = np.array([len(s) for s in streams], np.int64)
        if not n.sum():
            continue
        s, owner = np.concatenate(streams), np.repeat(np.arange(len(part)), n)
        h, lengths = term_hashes(s)
        at = ((h >> np.uint64(20)) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
        hit = np.flatnonzero(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & (h > 0))
        hit = hit[hit + lengths[hit] <= len(s)]
        hit = hit[owner[hit] == owner[hit + lengths[hit] - 1]]
        yield h[hit].view(np.int64), part[owner[hit]], hit - (np.cumsum(n) - n)[owner[hit]]


def frequencies(corpus: DataFrame, bits: np.ndarray) -> DataFrame:
    """corpus(text) -> term, n: how often each term of the filter stands in the corpus."""
    shared = corpus.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, _, _ in _hits(batch, shared.value):
                terms, n = np.unique(h, return_counts=True)
                yield pd.DataFrame({"term": terms, "n": n})

    return corpus.select("text").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(corpus: DataFrame, bits: np.ndarray) -> DataFrame:
    """corpus(key, text) -> term, key, pos, for the terms of the filter."""
    shared = corpus.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy()
            for h, row, pos in _hits(batch, shared.value):
                yield pd.DataFrame({"term": h, "key": keys[row], "pos": pos.astype(np.int32)})

    return corpus.select("key", "text").mapInPandas(run, "term long, key long, pos int")


def askable(terms: DataFrame) -> DataFrame:
    """terms(item, term, off) -> item, term, off, stretch, spread, whole: what an item may ask for.

    `spread` is the number of items with the term, `whole` the weight of a passage that holds the whole item.
    """
    spread = terms.groupBy("term").agg(F.countDistinct("item").alias("spread"))
    rows = terms.join(spread, "term").withColumn("stretch", F.expr(f"off div {STRETCH}"))
    rare = F.when(F.col("spread") <= RARE, F.col("stretch"))
    per = rows.groupBy("item").agg((F.countDistinct(rare) / F.countDistinct("stretch")).alias("share"))
    rows = rows.join(per, "item").where((F.col("share") < 0.5) | (F.col("spread") <= RARE))
    best = F.row_number().over(Window.partitionBy("item", "stretch").orderBy("spread", "off"))
    whole = rows.withColumn("n", best).where(F.col("n") <= RAREST).groupBy("item").agg(F.sum(1.0 / F.col("spread")).alias("whole"))
    return rows.join(whole, "item").select("item", "term", "off", "stretch", "spread", "whole")


def asked(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """terms as of `askable`, counts(term, n) of the corpus -> item, term, off, weight, whole: the rarest terms present."""
    order = Window.partitionBy("item", "stretch").orderBy("spread", "n", "off")
    picked = terms.join(counts, "term").withColumn("place", F.row_number().over(order)).where(F.col("place") <= RAREST)
    return picked.select("item", "term", "off", (1.0 / F.col("spread")).alias("weight"), "whole")


def leaked(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """corpus(doc_id, text) x items(item_id, text) -> doc_id, item_id, share, characters of every leaked passage."""
    corpus = corpus.where((F.length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    items = items.where((F.length("text") > 0) & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    members = written(items.select("item_id", F.min("item_id").over(Window.partitionBy("text")).alias("item"), "text"), "items")
    whole = written(item_terms(members.where("item_id = item")), "item-terms")
    terms = written(askable(whole.select("item", F.posexplode("terms").alias("off", "term")).where("term <> 0")), "askable")
    picks = written(asked(terms, frequencies(corpus, asked_filter(terms))), "asked")
    index = written(postings(corpus, asked_filter(picks)).repartition("term").sortWithinPartitions("term"), "postings")
    hits = index.join(bounded_broadcast(picks, SMALL), "term").select("item", "key", (F.col("pos") - F.col("off")).alias("diagonal"), "weight", "whole")
    shifted = hits.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(WIDTH // 2))))
    bucket = F.floor((F.col("diagonal") + F.col("shift")) / WIDTH)
    heavy = (
        shifted.groupBy("item", "key", "shift", bucket.alias("bucket"))
        .agg(F.count("*").alias("hits"), F.sum("weight").alias("weight"), F.max("whole").alias("whole"))
        .where((F.col("hits") >= HITS) & (F.col("weight") >= WEIGHT * F.col("whole")))
    )
    center = (F.col("bucket") * WIDTH - F.col("shift") + WIDTH // 2).cast("int")
    candidates = written(heavy.groupBy("item", "key").agg(F.collect_set(center).alias("diagonals")), "candidates")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                every = term_hashes(stream(r.text))[0].view(np.int64)
                own, lengths = np.asarray(r.terms), np.asarray(r.lengths)
                share, covered = max(passage(own, lengths, r.cjk, every, int(d)) for d in r.diagonals)
                if share >= SHARE:
                    out.append((r.doc_id, r.item, share, covered))
            yield pd.DataFrame(out, columns=["doc_id", "item", "share", "characters"])

    documents = corpus.join(bounded_broadcast(candidates.select("key").distinct(), SMALL), "key", "left_semi").dropDuplicates(["key"])
    found = documents.join(candidates, "key").join(whole, "item").mapInPandas(verify, "doc_id long, item long, share double, characters int")
    found = found.groupBy("doc_id", "item").agg(F.max("share").alias("share"), F.max("characters").alias("characters"))
    return found.join(members.select("item", "item_id"), "item").select("doc_id", "item_id", "share", "characters")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
SQL: dict[str, str] = {}
