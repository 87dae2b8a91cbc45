"""Problem 7: documents packed into training sequences of fixed length.

Sizes are token counts of a public tokenizer. A document longer than the capacity is split into full sequences and a rest;
only the rest is packed with others. The rests are dealt at random to blocks of bounded size; each block is packed by a
grouping genetic algorithm on several islands:

* a solution is a list of bins; crossover injects the best-filled bins of one parent whole into the other, removes the bins
  that hold a document twice, lets displaced documents replace smaller ones where they fit better, and inserts the rest
  best-fit, largest first; an island above the lower bound goes on as long as it gains bins;
* each island evolves its own population; after an epoch its elite migrates to the next island of the block, as rows of a
  shuffle on (block, island), and the best elite of the islands is the block's packing.

Then the bins that are filled worst in all blocks are opened, dealt to new blocks and packed again, so that leftovers of
different blocks meet. Blocks bound memory and time of a task whatever the table's size; there is no task that sees all.

Edge cases: null and empty texts are not packed; a text of exactly the capacity fills its sequence alone; equal texts are
packed like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans import written
from quillgraph.sources import table

CAPACITY = 2048
#: Folder and file of the public tokenizer.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
#: The pattern of the byte-level tokenizers, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a block, islands of a block, solutions of an island, generations of an epoch.
BLOCK, ISLANDS, POPULATION, GENERATIONS, EPOCHS = 1000, 2, 4, 12, 2
#: Generations that an island goes on after its last gain of a bin, and at most, while it is above the lower bound.
PATIENCE, LONGEST = 6, 60
#: Bins of up to this many items are also searched for pairs that a displaced item can replace.
PAIRED = 12
#: Bins under this fill are opened again after the first round.
REOPEN = 0.985


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """documents(doc_id, text) -> doc_id, tokens of the non-empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": np.array([len(encoding.encode_ordinary(t)) for t in batch["text"]], np.int64)})

    return documents.where(F.length("text") > 0).select("doc_id", "text").mapInPandas(run, "doc_id long, tokens long")


Bins = list[list[int]]


def best_fit(order: list[int], sizes: np.ndarray, bins: Bins, room: list[int], capacity: int) -> None:
    """Puts items into the fullest bin that still takes them, opening bins as needed."""
    free = sorted((r, k) for k, r in enumerate(room))
    for i in order:
        size = int(sizes[i])
        at = bisect_left(free, (size, -1))
        if at == len(free):
            bins.append([i])
            room.append(capacity - size)
            insort(free, (room[-1], len(bins) - 1))
        else:
            _, k = free.pop(at)
            bins[k].append(i)
            room[k] -= size
            insort(free, (room[k], k))


def cost(bins: Bins, sizes: np.ndarray, capacity: int) -> float:
    """Falls with the number of bins, then with the concentration of room in few bins."""
    fill = np.array([sizes[b].sum() for b in bins]) / capacity
    return len(bins) - float((fill**2).mean()) if bins else 0.0


def crossover(one: Bins, two: Bins, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """Well-filled bins of `one` go whole into `two`."""
    fill = np.array([sizes[b].sum() for b in one])
    top = np.argsort(-fill, kind="stable")[: max(1, int(len(one) * rng.uniform(0.3, 0.8)))]
    given = [list(one[k]) for k in top]
    taken = {i for b in given for i in b}
    kept, displaced = [], []
    for b in two:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    bins = given + kept
    return _refit(bins, displaced, sizes, capacity, rng)


def mutate(bins: Bins, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """The worst-filled bins and a few others are emptied and their items inserted anew."""
    fill = np.array([sizes[b].sum() for b in bins])
    drop = set(np.argsort(fill, kind="stable")[: max(2, len(bins) // 8)]) | set(rng.choice(len(bins), max(1, len(bins) // 20)))
    displaced = [i for k in drop for i in bins[k]]
    return _refit([list(b) for k, b in enumerate(bins) if k not in drop], displaced, sizes, capacity, rng)


def exchange(bins: Bins, room: list[int], displaced: list[int], sizes: np.ndarray) -> list[int]:
    """Displaced items take the place of one or two smaller ones in bins where they leave less room; what is displaced then."""
    loose = sorted((int(sizes[i]), i) for i in displaced)
    for k, own in enumerate(bins):
        if not loose:
            break
        if room[k] <= 0:
            continue
        best = (0, 0, ())
        for x, i in enumerate(own):
            for out in [(i,), *((i, j) for j in own[x + 1 :])] if len(own) <= PAIRED else [(i,)]:
                low = int(sum(sizes[o] for o in out))
                at = bisect_left(loose, (low + room[k] + 1, -1)) - 1
                if at >= 0 and loose[at][0] - low > best[0]:
                    best = (loose[at][0] - low, at, out)
        gain, at, out = best
        if gain:
            _, i = loose.pop(at)
            own[:] = [o for o in own if o not in out] + [i]
            room[k] -= gain
            for o in out:
                insort(loose, (int(sizes[o]), o))
    return [i for _, i in loose]


def _refit(bins: Bins, displaced: list[int], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """Displaced items go best-fit into the bins, largest first, in a slightly shuffled order."""
    room = [capacity - int(sizes[b].sum()) for b in bins]
    displaced = exchange(bins, room, displaced, sizes)
    order = sorted(displaced, key=lambda i: -sizes[i] * rng.uniform(0.9, 1.1))
    best_fit(order, sizes, bins, room, capacity)
    return bins


def evolve(sizes: np.ndarray, start: list[Bins], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> Bins:
    """The best solution of an island after some generations."""
    rng = np.random.default_rng(seed)
    pool = list(start)
    while len(pool) < population:
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (rng.uniform(0.85, 1.15) if pool else 1.0))
        bins: Bins = []
        best_fit(order, sizes, bins, [], capacity)
        pool.append(bins)
    scored = sorted(((cost(b, sizes, capacity), k, b) for k, b in enumerate(pool)), key=lambda x: x[:2])
    least = -(-int(sizes.sum()) // capacity)
    until, fewest = generations, len(scored[0][2])
    for g in range(max(generations, LONGEST)):
        if fewest <= least or g >= until:
            break
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[min(a, b)][2], scored[max(a, b)][2], sizes, capacity, rng)
        if rng.random() < 0.6:
            child = mutate(child, sizes, capacity, rng)
        scored.append((cost(child, sizes, capacity), population + g, child))
        scored = sorted(scored, key=lambda x: x[:2])[:population]
        if len(scored[0][2]) < fewest:
            until, fewest = max(until, g + 1 + PATIENCE), len(scored[0][2])
    return scored[0][2]


def plain(sizes: np.ndarray, capacity: int) -> Bins:
    """Best-fit decreasing, for comparison."""
    bins: Bins = []
    best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, bins, [], capacity)
    return bins


def _epoch(items: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """items(block, island, item, size, bins) -> the same with each island's best bins; bins holds the islands' elites by item."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item", kind="stable").reset_index(drop=True)
        sizes = group["size"].to_numpy()
        start = []
        for column in ("bin", "guest"):
            if (group[column] >= 0).all():
                start.append([list(v) for v in group.groupby(column).indices.values()])
        seed = int(group["block"].iloc[0]) * 1000 + int(group["island"].iloc[0]) * 10 + epoch
        best = evolve(sizes, start, capacity, seed)
        where = np.empty(len(group), np.int64)
        for k, b in enumerate(best):
            where[b] = k
        return group.assign(bin=where, guest=np.int64(-1), cost=cost(best, sizes, capacity))

    return items.groupBy("block", "island").applyInPandas(run, "block long, island int, item long, size long, bin long, guest long, cost double")


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, epochs: int = EPOCHS, islands: int = ISLANDS, salt: int = 0) -> DataFrame:
    """items(item, size up to the capacity) -> item, size, block, bin."""
    n = items.count()
    blocks = max(1, -(-n // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(blocks)))
    state = dealt.withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(islands))))).withColumns({"bin": F.lit(-1).cast("long"), "guest": F.lit(-1).cast("long")})
    for epoch in range(epochs):
        state = written(_epoch(state.select("block", "island", "item", "size", "bin", "guest"), capacity, epoch), "islands")
        if epoch + 1 < epochs:
            # the elite of an island migrates to the next one
            guests = state.select("block", ((F.col("island") + 1) % islands).alias("island"), "item", F.col("bin").alias("came"))
            state = state.join(guests, ["block", "island", "item"]).select("block", "island", "item", "size", "bin", F.col("came").alias("guest"))
    best = state.groupBy("block").agg(F.min(F.struct("cost", "island")).alias("best")).select("block", F.col("best.island").alias("island"))
    return state.join(best, ["block", "island"]).select("item", "size", "block", "bin")


def packed(sizes: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """sizes(doc_id, tokens) -> doc_id, part, tokens, sequence: the assignment of documents to sequences."""
    sizes = written(sizes.select("doc_id", "tokens").where("tokens > 0").dropDuplicates(["doc_id"]), "sizes")
    full = (
        sizes.where(F.col("tokens") >= capacity)
        .select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"tokens div {capacity} - 1"))).alias("part"))
        .select("doc_id", "part", F.lit(capacity).cast("long").alias("tokens"), F.concat_ws("-", F.lit("f"), "doc_id", "part").alias("sequence"))
    )
    rests = sizes.select("doc_id", F.expr(f"tokens div {capacity}").alias("part"), (F.col("tokens") % capacity).alias("tokens")).where("tokens > 0")
    first = written(pack(rests.select(F.col("doc_id").alias("item"), F.col("tokens").alias("size")), capacity, block), "packed")
    fill = first.groupBy("block", "bin").agg(F.sum("size").alias("fill"))
    marked = first.join(fill, ["block", "bin"])
    good = marked.where(F.col("fill") >= REOPEN * capacity).select("item", F.concat_ws("-", F.lit("a"), "block", "bin").alias("sequence"))
    again = written(marked.where(F.col("fill") < REOPEN * capacity).select("item", "size"), "reopened")
    second = pack(again, capacity, block, salt=1).select("item", F.concat_ws("-", F.lit("b"), "block", "bin").alias("sequence"))
    placed = rests.join(good.unionByName(second).withColumnRenamed("item", "doc_id"), "doc_id")
    return full.unionByName(placed.select("doc_id", "part", "tokens", "sequence"))


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(token_sizes(table(spark, sf_dir, "documents")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences, the least number possible, what best-fit decreasing takes in the same blocks, the part of the room in use."""
    sizes = written(token_sizes(table(spark, sf_dir, "documents")), "tokens")
    bins = packed(sizes).groupBy("sequence").agg(F.sum("tokens").alias("fill"))
    whole = bins.agg(F.count("*").alias("sequences"), F.ceil(F.sum("fill") / CAPACITY).alias("least"), (F.sum("fill") / (F.count("*") * CAPACITY)).alias("used"), F.max("fill").alias("fullest"))
    sizes = sizes.dropDuplicates(["doc_id"])
    full = sizes.agg(F.coalesce(F.sum(F.expr(f"tokens div {CAPACITY}")), F.lit(0)).alias("full"))
    rests = sizes.select("doc_id", (F.col("tokens") % CAPACITY).alias("size")).where("size > 0")
    blocks = max(1, -(-rests.count() // BLOCK))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(plain(group.sort_values("doc_id")["size"].to_numpy(), CAPACITY))]})

    fit = rests.groupBy(F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(blocks)).alias("block")).applyInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return whole.crossJoin(full).crossJoin(fit).select("sequences", "least", (F.col("full") + F.col("n")).alias("best_fit"), "used", "fullest")


QUERIES = {"p7_sequences": p7_sequences, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
