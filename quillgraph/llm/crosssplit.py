"""Problem 3: the same or almost the same question in the training split and in an evaluation split.

1. Canonical form: width, case, accents, style of characters and punctuation folded, courtesy words and synonymous
   question words unified. Questions with one canonical form and one answer are one class: (representative, members).
2. MinHash over character shingles of the representatives. A shingle's hash is an exponential variable whose rate is a
   power of its inverse document frequency, so that two texts agree in a minimum with the probability of their weighted
   Jaccard similarity: shared question patterns count little, names count much, and no shingle is dropped. Banded buckets
   keep pairs of a class with training rows and a class with evaluation rows only.
3. Exact checks of each candidate: Jaccard similarity of the shingles, and an alignment of the words that may differ by
   slips of the pen but not by another name or attribute. One wording is confirmed by itself; where letters differ, equal
   answers (up to a slip) are the witness that a changed name is a slip and not another name.
4. Confirmed pairs of classes, and classes that stand in both splits, give the row pairs through the membership.

Document frequencies cover all rows; they live in a hashed table of fixed size (`BUCKETS`), which bounds the broadcast.

Edge cases: null or empty questions and rows with no split match nothing; null answers equal each other; repeated ids give
one row; a text shorter than a shingle is its own shingle; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.text import TO_SIMPLIFIED
from quillgraph.plans import written
from quillgraph.sources import table

BUCKETS = 1 << 20
BANDS, ROWS = 48, 3
#: Power of the inverse document frequency in a shingle's weight.
POWER = 4.0
JACCARD = 0.5
#: A word in this share of the questions or more is a word of its own, not a slip.
COMMON = 0.001

#: Courtesy words around a question, and question words that mean the same.
OPENING = re.compile(
    r"^(?:【[^】]{1,6}】|\[[^\]]{1,6}\]|请问一下|请问|想问一下|想请问|麻烦问一下|麻烦问下|问题?[:：]|题目?\s*\d*\s*[.、:：]|题目|\d{1,4}\s*[.、)）:]|"
    r"please tell me|question\s*\d*[:.]|q\s*\d*[:.]|hello|hi|excuse me)[\s,，:：.、]*"
)
CLOSING = re.compile(r"(?:请用[^。]{1,4}作答|please answer in \w+|thank you|thanks|谢谢|[呀呢吗啊])[\s。.!！?？]*$")
SAME = [("有谁知道", "谁能告诉我"), ("谁知道", "谁能告诉我"), ("啥", "什么"), ("哪个", "哪一个"), ("之", "的"), ("那", "的"), ("里面", "里"), ("》中", "》里"), ("中,", "里,")]
SAME_WORDS = {"was": "is", "were": "are", "whats": "what", "which": "what", "for": "of", "does": "do", "gives": "give", "page": "pages"}

TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


def canonical(question: str) -> str:
    """Words and single CJK characters of the folded question, parted by spaces."""
    t = unicodedata.normalize("NFKC", question).lower().translate(TO_SIMPLIFIED).strip()
    for _ in range(3):
        t = OPENING.sub("", t)
        t = CLOSING.sub("", t)
    for a, b in SAME:
        t = t.replace(a, b)
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return " ".join(SAME_WORDS.get(w, w) for w in TOKEN.findall(t.replace("’", "'").replace("'s", "")))


def shingles(canon: str) -> list[str]:
    """Pairs of neighbouring CJK characters, four letters of words."""
    out, squeezed = set(), canon.replace(" ", "")
    for k in range(len(squeezed) - 1):
        n = 2 if squeezed[k] >= "㐀" else 4
        if k + n <= len(squeezed):
            out.add(squeezed[k : k + n])
    return sorted(out) or [squeezed]


def hashes(texts: list[str]) -> np.ndarray:
    """A 64-bit hash of each text."""
    return pd.util.hash_array(np.array(texts, dtype=object), categorize=False)


def _word_at(words: list[str]) -> np.ndarray:
    """Places of words in the table, by other bits of the hash than those of shingles."""
    return ((hashes(words) >> np.uint64(30)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counts(canons: DataFrame) -> tuple[np.ndarray, int]:
    """Hashed document frequencies of shingles (row 0) and words (row 1), and the number of rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((2, BUCKETS), np.int64), 0
        for batch in batches:
            n += len(batch)
            if len(batch):
                flat = [x for c in batch["canon"] for x in shingles(c)]
                words = [w for c in batch["canon"] for w in set(c.split())]
                total[0] += np.bincount((hashes(flat) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                total[1] += np.bincount(_word_at(words), minlength=BUCKETS)
        at = np.flatnonzero(total.ravel())
        yield pd.DataFrame({"at": np.append(at, -1).astype(np.int32), "n": np.append(total.ravel()[at], n)})

    rows = canons.select("canon").mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table_ = np.zeros(2 * BUCKETS)
    real = rows[rows["at"] >= 0]
    table_[real["at"].to_numpy()] = real["n"].to_numpy()
    return table_.reshape(2, BUCKETS), int(rows.loc[rows["at"] < 0, "n"].sum())


def _distance(a: str, b: str, most: int = 2) -> int:
    """Edits (a swap of neighbours is one) between two words, at most `most` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return min(one[-1], most + 1)


def same_words(a: str, b: str, sure: bool, common) -> bool:
    """Whether two canonical questions differ only by slips.

    `sure`: the answers are equal and say something, so that a slip may be larger. common(word): a word of its own.
    """
    if a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = Counter(a.split()), Counter(b.split())
    left, right = list((x - y).elements()), list((y - x).elements())
    lc, rc = [w for w in left if w >= "㐀"], [w for w in right if w >= "㐀"]
    lw, rw = [w for w in left if w < "㐀"], [w for w in right if w < "㐀"]
    if len(lc) + len(rc) > (4 if sure else 2) or max(len(lc), len(rc)) > (3 if sure else 2):
        return False
    edits = 0
    for w in sorted(lw, key=lambda w: (-len(w), w)):
        near = min(rw, key=lambda v: (_distance(w, v), v), default=None)
        short = near is not None and min(len(w), len(near)) < 3
        if near is not None and _distance(w, near) <= (1 if short else 2) and not (common(w) and common(near)):
            edits += _distance(w, near)
            rw.remove(near)
        elif len(w) <= 2 and not w.isdigit():
            edits += 1
        else:
            return False
    return all(len(v) <= 2 and not v.isdigit() for v in rw) and edits + len(rw) <= 3


def agree(a: str, b: str) -> bool:
    """Whether two canonical answers are one, up to slips in long ones."""
    return a == b or (min(len(a), len(b)) >= 8 and _distance(a, b, 1) <= 1)


def overlaps(questions: DataFrame) -> DataFrame:
    """questions(id, question, split, answer, open) -> id_a, id_b (smaller first), jaccard.

    `answer` is text to compare, `open` is true where the answer says nothing (a refusal).
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            canon = [canonical(q) for q in batch["question"]]
            answer = ["" if a is None else canonical(a) for a in batch["answer"]]
            yield pd.DataFrame({"id": batch["id"], "train": batch["train"], "canon": canon, "answer": answer, "open": batch["open"]})

    rows = (
        questions.where(F.length("question") > 0)
        .select("id", "question", "answer", F.coalesce("open", F.lit(False)).alias("open"), F.when(F.col("split") == "train", True).when(F.col("split").isin("dev", "test"), False).alias("train"))
        .where(F.col("train").isNotNull())
        .mapInPandas(fold, "id string, train boolean, canon string, answer string, open boolean")
        .where("canon <> ''")
        .dropDuplicates(["id"])
    )
    rows = written(rows, "questions")
    counts, n = _counts(rows)
    idf = rows.sparkSession.sparkContext.broadcast((np.log((n + 1) / (counts[0] + 0.5)).clip(0.05).astype(np.float32), counts[1] >= max(3, COMMON * n)))
    keys = ["canon", "answer", "open"]
    classes = rows.groupBy(*keys).agg(F.min("id").alias("class"), F.max("train").alias("has_train"), (~F.min("train")).alias("has_eval"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = idf.value[0]
        seeds = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            own = [shingles(c) for c in batch["canon"]]
            if not own:
                continue
            h = hashes([x for o in own for x in o])
            rate = weights[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.float64) ** POWER
            starts = np.cumsum([0] + [len(o) for o in own[:-1]])
            bucket = np.zeros((len(own), BANDS), np.uint64)
            for k, seed in enumerate(seeds):
                mixed = (h ^ (h >> np.uint64(31))) * seed
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                u = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
                # the least value stands for its shingle: no two shingles share a value
                least = np.minimum.reduceat(-np.log(u) / rate, starts).view(np.uint64)
                band = bucket[:, k // ROWS]
                band = (band ^ least) * np.uint64(0x9E3779B97F4A7C15)
                bucket[:, k // ROWS] = band ^ (band >> np.uint64(29))
            each = {c: np.repeat(batch[c].to_numpy(), BANDS) for c in ("class", "has_train", "has_eval")}
            yield pd.DataFrame(each | {"band": np.tile(np.arange(BANDS, dtype=np.int32), len(own)), "bucket": bucket.astype(np.int64).ravel()})

    classes = written(classes, "classes")
    signed = classes.mapInPandas(sign, "class string, has_train boolean, has_eval boolean, band int, bucket long")
    left = signed.where("has_train").select("band", "bucket", F.col("class").alias("a"), F.col("has_eval").alias("a_eval"))
    right = signed.where("has_eval").select("band", "bucket", F.col("class").alias("b"), F.col("has_train").alias("b_train"))
    candidates = (
        left.join(right, ["band", "bucket"])
        .where("a <> b and not (a_eval and b_train and a > b)")
        .select("a", "b")
        .distinct()
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = lambda w: bool(idf.value[1][_word_at([w])[0]])
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                x, y = set(shingles(r.canon_a)), set(shingles(r.canon_b))
                jaccard = len(x & y) / len(x | y)
                if jaccard < JACCARD:
                    continue
                # one wording is one question, whatever its answer; slips need a witness that it isn't another entity's
                one = r.canon_a.replace(" ", "") == r.canon_b.replace(" ", "")
                witness = agree(r.answer_a, r.answer_b) and r.open_a == r.open_b
                if one or (witness and same_words(r.canon_a, r.canon_b, not r.open_a and r.answer_a != "", common)):
                    out.append((r.a, r.b, jaccard))
            yield pd.DataFrame(out, columns=["a", "b", "jaccard"])

    side = lambda s: classes.select(F.col("class").alias(s), *(F.col(k).alias(f"{k}_{s}") for k in keys))
    confirmed = candidates.join(side("a"), "a").join(side("b"), "b").mapInPandas(verify, "a string, b string, jaccard double")
    confirmed = confirmed.unionByName(classes.where("has_train and has_eval").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("jaccard")))
    members = rows.join(classes.select("class", *keys), keys).select("id", "train", "class")
    both = confirmed.select("a", "b", "jaccard").unionByName(confirmed.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    trained = members.where("train").select(F.col("id").alias("t"), F.col("class").alias("a"))
    held = members.where("not train").select(F.col("id").alias("e"), F.col("class").alias("b"))
    return both.join(trained, "a").join(held, "b").groupBy(F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b")).agg(F.max("jaccard").alias("jaccard"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "eval_set")
    return overlaps(q.select("id", "question", "split", F.col("gold_answer").alias("answer"), F.col("expect_refusal").alias("open")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("id_a", "id_b")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation questions that stand in train, and pairs, per split and source of the evaluation row."""
    q = table(spark, sf_dir, "eval_set").where("split in ('dev', 'test')").select("id", "split", "source")
    pairs = _overlaps(spark, sf_dir)
    ends = pairs.select(F.col("id_a").alias("id")).unionByName(pairs.select(F.col("id_b").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    return ends.join(q, "id").groupBy("split", "source").agg(F.count("*").alias("questions"), F.sum("n").alias("pairs"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
SQL: dict[str, str] = {}
