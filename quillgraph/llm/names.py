"""Problem 1: the many spellings of one character, group, place, item or show.

1. Distinct spellings are parsed: look-alikes, style of characters, honorifics, edition marks and separators are folded; the
   kind (a suffix such as a club or a castle, with its synonyms) and a generation or number mark are split off and must be
   equal for a match; what is left is a given and a family part, in Chinese characters or in letters. The order of the
   parts is decided by how often a character begins or ends names (a table learnt from all records and triple ends, with or
   without aliases; the table of syllables that turns Chinese parts into letters is learnt from all records that spell a
   name in both scripts; both hold one entry a character, all that reaches the driver).
2. Metric-space partitioning. Edit distance is a metric, but between unrelated names it is almost constant, so that a few
   distant pivots can't separate them. Every name is therefore a pivot of a cell of radius 0, and a name is replicated
   into the cells of the pivots within the join radius: by the triangle inequality these hold all its partners. The pivots
   in reach are found through one-character deletions (two strings within one insertion, deletion, substitution or swap
   share a string after at most one deletion from each), and inside the cells the exact distance is checked. A cell holds
   distinct spellings only, never copies.
3. In each cell a spelling follows its most frequent partner; Chinese names then follow their romanised form, so that both
   scripts meet. Initials and nicknames are resolved over the family part if exactly one entity fits,
   else over an alias of the record that agrees with the short name.

Records and triple ends get their entity by equi joins on the spelling; pairs of records come from one entity's records
only, ends are matched with the records of their entity.

Edge cases: null and empty names mean nothing; repeated records give one row; a spelling that can't be parsed is its own
entity, so that equal spellings still meet; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.lookalikes import FOREIGN, IS_IGNORABLE, LATIN
from quillgraph.llm.text import TO_SIMPLIFIED
from quillgraph.plans import bounded_broadcast, shuffled, written
from quillgraph.sources import table

#: Added to the weight of a name in letters that a name in characters is read as.
HEAVY = 1_000_000
#: Shows are a fixed dimension, compared with every spelling; more than this are refused.
SHOWS = 100_000
#: Rounds in which syllables are learnt, the unit in which shares are added up, and weights up to which a join may broadcast them.
ROUNDS, UNIT, WEIGHTS = 4, 1 << 30, 100_000
#: Kinds of groups, places and things with their synonyms in both languages.
KINDS = {
    "sailing": ("航海协会", "航海会", "Sailing Society"), "salvage": ("拾荒者团", "拾荒团", "Salvage Crew"), "choir": ("合唱团", "合唱队", "Choir"),
    "flying": ("飞行小队", "飞行队", "Flying Squad"), "expedition": ("探险小队", "探险队", "Expedition Team"), "repair": ("修理小组", "修理社", "Repair Club"),
    "watch": ("守夜人协会", "守夜会", "Night Watch"), "chess": ("棋艺社", "棋社", "Chess Club"),
    "museum": ("纪念馆", "Museum", "Memorial Hall"), "house": ("故居", "Former Residence"), "statue": ("雕像", "Statue"),
    "school": ("学堂", "学校", "School"), "manor": ("山庄", "庄园", "Manor"), "ferry": ("渡口", "渡", "Ferry"), "forestry": ("林场", "林区", "Forestry"),
    "fort": ("城堡", "堡", "Fort"), "valley": ("山谷", "谷", "Valley"), "island": ("小岛", "岛", "Island"), "town": ("小镇", "镇", "Town"),
    "flute": ("之笛", "笛", "Flute"), "shield": ("之盾", "盾", "Shield"), "mirror": ("之镜", "镜", "Mirror"), "key": ("之钥匙", "之钥", "钥匙", "钥", "Key"),
    "bell": ("之铃", "铃", "Bell"), "lamp": ("之灯", "灯", "Lamp"),
}
#: Honorifics, marks of an edition, marks of a generation or number.
BEFORE = re.compile(r"^(?:老|小|captain |old |dr\.? |mr\.? |mrs\.? |ms\.? |prof\.? |professor )", re.I)
AFTER = re.compile(r"(?:先生|女士|大婶|大叔|老师|队长|博士|教授|船长)$")
EDITION = re.compile(r"(?:·?初代译名|[(（](?:旧译|新译|港译|台版|港版|台译|旧版|新版|陆译)[)）])$")
GENERATION = re.compile(r"(?:[(（]\s*(\d{1,3}|二代|三代|四代|小|大|老|第?[二三四]代)\s*[)）]|([二三四]世)|第?([二三四]代)|\b(I{2,3}|IV|Jr|Sr|\d{1,2}(?:nd|rd|th)?)\.?)$", re.I)
LETTERS = "[a-z]"
CJK = "㐀-鿿"
SEPARATORS = "·_/-"

MARKED_KINDS = sorted(((w, k) for k, words in KINDS.items() for w in words if w >= "㐀"), key=lambda x: -len(x[0]))
LATIN_KINDS = {w.lower(): k for k, words in KINDS.items() for w in words if w < "㐀"}


def folded(name: str) -> str:
    t = unicodedata.normalize("NFKC", name)
    t = IS_IGNORABLE.sub("", t)
    t = re.sub(r"[⋅‧∙・•·]", "·", t)
    if re.search("[a-zA-Z]", t):
        t = t.translate(str.maketrans(FOREIGN, LATIN))
    t = unicodedata.normalize("NFD", t.translate(TO_SIMPLIFIED))
    t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", t).strip()


def near(a: str, b: str) -> bool:
    """Whether two strings are within one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Tables:
    """What is learnt from records: syllables of characters, and whether a character stands in given or family parts."""

    def __init__(self, syllables: dict[str, str], given: dict[str, float]):
        self.syllables, self.given = syllables, given

    def order(self, core: str) -> tuple[str, str]:
        """Given and family part of a run of Chinese characters, in either order, of five to seven characters."""
        best = None
        for k in {3, len(core) - 3}:
            one, two = core[:k], core[k:]
            score = sum(self.given.get(c, 0.5) - 0.5 for c in one) - sum(self.given.get(c, 0.5) - 0.5 for c in two)
            for s, parts in ((score, (one, two)), (-score, (two, one))):
                if best is None or s > best[0] + 1e-9:
                    best = (s, parts)
        return best[1]

    def letters(self, part: str) -> str | None:
        got = [self.syllables.get(c) for c in part]
        return None if None in got else "".join(got)


SYLLABLE = re.compile(r"(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?[aeiouv]+(?:ngg?|nn|n|r)?")


def _segments(word: str, n: int) -> list[tuple[str, ...]]:
    if n == 0:
        return [()] if not word else []
    out = []
    for k in range(1, min(7, len(word)) + 1):
        if SYLLABLE.fullmatch(word[:k]):
            out += [(word[:k], *rest) for rest in _segments(word[k:], n - 1)]
    return out


def spoken(name: str, aliases: Iterable[str] | None) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Of a record: each character of its Chinese names with g or f for the part it stands in; parts in characters and in letters."""
    forms = [folded(x) for x in (name, *(() if aliases is None else aliases)) if x]
    chinese = [m for f in forms if (m := re.fullmatch(f"([{CJK}]{{2,3}})·([{CJK}]{{3}})", f))]
    latin = [m for f in forms if (m := re.fullmatch(r"([A-Za-z]{4,}) ([A-Za-z]{4,})", f))]
    stands = [(c, which) for m in chinese for k, which in ((1, "g"), (2, "f")) for c in m.group(k)]
    return stands, [(chinese[0].group(k), latin[0].group(k).lower()) for k in (1, 2)] if chinese and latin else []


def stored(df: DataFrame, label: str) -> DataFrame:
    """As `written`, kept from broadcasts: files of names are a small part of their rows, all the more once these are exploded."""
    return shuffled(written(df, label))


def learn(records: list[tuple[str, list[str]]]) -> Tables:
    """Tables from (name, aliases) of records that spell one name in both scripts."""
    pairs: list[tuple[str, str]] = []
    places: dict[str, Counter] = defaultdict(Counter)
    for name, aliases in records:
        stands, parts = spoken(name, aliases)
        for c, which in stands:
            places[c][which] += 1
        pairs += parts
    options = [(c, s) for c, w in pairs if (s := _segments(w, len(c)))]
    weight: dict[tuple[str, str], float] = defaultdict(lambda: 1.0)
    for _ in range(ROUNDS):
        counts: Counter = Counter()
        for chars, ways in options:
            shares = [1.0] * len(ways)
            for k, way in enumerate(ways):
                for c, x in zip(chars, way, strict=True):
                    shares[k] *= weight[c, x]
            total = sum(shares) or 1.0
            for share, way in zip(shares, ways, strict=True):
                for c, x in zip(chars, way, strict=True):
                    counts[c, x] += share / total
        sums: Counter = Counter()
        for (c, _), n in counts.items():
            sums[c] += n
        weight = defaultdict(lambda: 1e-4, {(c, x): n / sums[c] for (c, x), n in counts.items()})
    best: dict[str, tuple[float, str]] = {}
    for (c, x), n in sorted(counts.items()) if options else []:
        if n >= 2 and n > best.get(c, (0.0, ""))[0]:
            best[c] = (n, x)
    given = {c: (n["g"] + 0.5) / (n["g"] + n["f"] + 1) for c, n in places.items()}
    return Tables({c: x for c, (_, x) in best.items()}, given)


def learnt(records: DataFrame) -> Tables:
    """The tables of `learn` from all rows of records(name, aliases), also those without a name or without aliases.

    Equal rows and parts are counted first, the rounds are joins and aggregations; the driver gets one row for each character of `CJK`.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for name, aliases, n in zip(batch["name"], batch["aliases"], batch["n"], strict=True):
                for found in spoken(name, aliases):
                    for what in found:
                        seen[what] += n
            yield pd.DataFrame([(*what, n) for what, n in seen.items()], columns=["chars", "word", "n"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(chars, word, n, way) for chars, word, n in batch.itertuples(index=False) for way in _segments(word, len(chars))]
            yield pd.DataFrame(rows, columns=["chars", "word", "n", "way"])

    def by_character(ways: DataFrame, *more: F.Column | str) -> DataFrame:
        return ways.select("*", F.posexplode("way").alias("place", "x")).select(*more, "place", F.expr("substring(chars, place + 1, 1)").alias("c"), "x")

    whole = records.groupBy("name", "aliases").agg(F.count("*").alias("n"))
    seen = stored(whole.mapInPandas(read, "chars string, word string, n long").groupBy("chars", "word").agg(F.sum("n").alias("n")), "seen")
    # a word has four letters at least
    ways = stored(seen.where("length(word) > 1").mapInPandas(split, "chars string, word string, n long, way array<string>"), "ways")
    weights = None
    for _ in range(ROUNDS):
        shares = ways.withColumn("share", F.lit(1.0))
        if weights is not None:
            held = by_character(ways, "chars", "word", "n", "way").join(bounded_broadcast(weights, WEIGHTS), ["c", "x"]).repartition("chars", "word")
            at = [F.coalesce(F.max(F.when(F.col("place") == k, F.col("weight"))), F.lit(1.0)) for k in range(3)]
            shares = held.groupBy("chars", "word", "n", "way").agg((at[0] * at[1] * at[2]).alias("share"))
        part = F.col("n") * F.greatest(F.lit(1), F.round(F.col("share") / F.sum("share").over(Window.partitionBy("chars", "word")) * UNIT).cast("long"))
        counts = by_character(shares.withColumn("part", part), "part").groupBy("c", "x").agg(F.sum("part").alias("part"))
        weights = stored(counts.withColumn("weight", F.col("part") / F.sum("part").over(Window.partitionBy("c"))), "weights")
    n = F.round(F.col("part") / UNIT, 6)
    best = weights.where(n >= 2).groupBy("c").agg(F.min(F.struct((-n).alias("n"), "x")).alias("best")).select("c", "best.x").collect()
    own = F.sum(F.when(F.col("word") == "g", F.col("n")).otherwise(0))
    places = seen.where("length(word) = 1").groupBy("chars").agg(own.alias("g"), F.sum("n").alias("all")).collect()
    return Tables({r.c: r.x for r in best}, {r.chars: (r.g + 0.5) / (r.all + 1) for r in places})


def parse(name: str, tables: Tables) -> tuple[str, str, str, str, str]:
    """(form, kind, mark, given, family) of a spelling. Forms: chinese, latin, initial, nick, clipped, other."""
    t = folded(name)
    mark = ""
    for _ in range(2):
        t = EDITION.sub("", t).strip()
        if m := GENERATION.search(t):
            mark = next(g for g in m.groups() if g).lower().replace("第", "")
            mark = {"二世": "2", "二代": "2", "ii": "2", "三世": "3", "三代": "3", "iii": "3", "小": "jr"}.get(mark, mark)
            t = t[: m.start()].strip()
    chinese = bool(re.search(f"[{CJK}]", t))
    kind = "person"
    if chinese:
        if m := re.fullmatch(f"([{CJK}]{{1,4}})[\"“”「]([{CJK} ·_/-]+)[\"“”」]", t):
            kind, t = next((k for w, k in MARKED_KINDS if w in (m.group(1), "之" + m.group(1))), "other"), m.group(2)
        elif m := re.fullmatch(f"阿([{CJK}])[(（]([{CJK}]{{3}})家[)）]", t):
            return "nick", kind, mark, m.group(1), m.group(2)
        elif m := re.fullmatch(f"([{CJK}]{{3}})家的([{CJK}]{{1,2}})", t):
            return "nick", kind, mark, m.group(2), m.group(1)
        else:
            bare = re.sub(f"[ {SEPARATORS}]", "", t)
            for word, k in MARKED_KINDS:
                if t.endswith(word) and 4 <= len(bare) - len(word) <= 7:
                    # a last part of three characters behind a separator is a family part, whatever it ends with
                    if len(word) == 1 and ("." in t or len(re.split(f"[ {SEPARATORS}]", t)[-1]) < 4):
                        continue
                    kind, t = k, t[: -len(word)]
                    break
        if kind == "person":
            t = AFTER.sub("", t)
        if kind == "person" and (m := re.fullmatch(f"([{CJK}])[.·_ -]?([{CJK}]{{3}})", t)):
            return "initial", kind, mark, m.group(1), m.group(2)
        if kind == "person" and (m := re.fullmatch(f"([{CJK}]{{2}})[ {SEPARATORS}]([{CJK}]{{3}})|([{CJK}])\\3([{CJK}]{{3}})", t)):
            # a doubled character, or a part of the given name, before the whole family part
            piece, family = (m.group(1), m.group(2)) if m.group(1) else (m.group(3), m.group(4))
            return "nick", kind, mark, piece[:1] if piece == piece[:1] * len(piece) else piece, family
        t = re.sub(rf"[ ,，、{SEPARATORS}]", "", t)
        if kind != "person" and re.fullmatch(f"[{CJK}]{{4}}", t):
            return "clipped", kind, mark, *sorted((t[:2], t[2:]))
        if kind == "person" and len(t) in (7, 8) and (m := re.match("[老小]", t)):
            t = t[1:]
        if re.fullmatch(f"[{CJK}]{{5,7}}", t):
            given, family = tables.order(t)
            return "chinese", kind, mark, given, family
        return "other", kind, mark, folded(name).lower(), ""
    t = BEFORE.sub("", t).lower()
    if m := re.fullmatch(r"([a-z]{4,}), ([a-z]{4,})", t):
        return "latin", kind, mark, m.group(2), m.group(1)
    if m := re.fullmatch(r"([a-z]{1,6})\. ?([a-z]{4,})", t):
        return "initial", kind, mark, m.group(1), m.group(2)
    words = t.split()
    if len(words) > 2:
        rest = " ".join(words[2:])
        kind = next((k for w, k in LATIN_KINDS.items() if near(rest, w)), "")
        if not kind:
            return "other", "person", mark, t, ""
    if len(words) >= 2 and all(re.fullmatch("[a-z]{3,}", w) for w in words[:2]):
        return "latin", kind, mark, words[0], words[1]
    return "other", kind, mark, t, ""


def within_radius(nodes: DataFrame) -> DataFrame:
    """nodes(cell, text, weight) -> cell, text, other, weight: the heavier texts within the radius of each text, and their weight."""
    keys = F.expr("array_distinct(concat(array(text), transform(sequence(1, length(text)), k -> concat(substring(text, 1, k - 1), substring(text, k + 1)))))")
    probes = nodes.where("text <> ''").select("cell", "text", "weight", F.explode(keys).alias("key"))
    swapped = F.expr(
        "length(text) = length(other) and exists(sequence(1, length(text)), k -> concat(substring(other, 1, k - 1), substring(other, k + 1, 1), substring(other, k, 1), substring(other, k + 2)) = text)"
    )
    return (
        probes.alias("x")
        .join(shuffled(probes).alias("y"), ["cell", "key"])
        .where("x.text <> y.text and (y.weight > x.weight or (y.weight = x.weight and y.text < x.text))")
        .select("cell", F.col("x.text").alias("text"), F.col("y.text").alias("other"), F.col("y.weight").alias("weight"))
        .distinct()
        .where((F.levenshtein("text", "other") <= 1) | swapped)
    )


def followed(nodes: DataFrame) -> DataFrame:
    """nodes(cell, text, weight) -> cell, text, lead: the heaviest text within the radius, itself included, followed to its end."""
    lead = within_radius(nodes).groupBy("cell", "text").agg(F.max(F.struct("weight", F.col("other").alias("lead"))).alias("best")).select("cell", "text", F.col("best.lead").alias("lead"))
    # leads are followed to their end: weights rise, or the text falls, at every step
    lead, moves = stored(lead, "leads"), True
    while moves:
        far = lead.select("cell", F.col("text").alias("lead"), F.col("lead").alias("far"))
        lead = stored(lead.join(far, ["cell", "lead"], "left").select("cell", "text", F.coalesce("far", "lead").alias("lead"), F.col("far").isNotNull().alias("moved")), "leads")
        moves = not lead.where("moved").isEmpty()
        lead = lead.drop("moved")
    return nodes.select("cell", "text").join(lead, ["cell", "text"], "left").select("cell", "text", F.coalesce("lead", "text").alias("lead"))


#: Characters from which other names may differ by one.
LEAST = 6


def plain_text(name: F.Column) -> F.Column:
    """The words of a name of any make in one order, without signs; Chinese characters stay in theirs."""
    bare = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N} ]+", " ")
    words = F.array_sort(F.filter(F.split(bare, " +"), lambda w: w != ""))
    return F.when(bare.rlike("[\u3400-\u9fff]"), F.replace(bare, F.lit(" "), F.lit(""))).otherwise(F.array_join(words, " "))


def agrees(form: str, piece: str, family: str, other: tuple[str, str, str], tables: Tables) -> bool:
    """Whether a full name, as (form, given, family), is one that an initial or nickname can stand for, in either script."""
    full, given, house = other
    if full == "latin" and family >= "㐀":
        piece, family = tables.letters(piece) or "", tables.letters(family) or ""
    elif full == "chinese" and family < "㐀":
        given, house = tables.letters(given[:1] if form == "initial" else given) or "", tables.letters(house) or ""
    ways = ((given, house), (house, given)) if full == "latin" else ((given, house),)
    return bool(piece and family) and any(near(family, h) and (g.startswith(piece) if form == "initial" else piece in g) for g, h in ways)


def followed_key(said: DataFrame, leads: DataFrame, letters: DataFrame) -> DataFrame:
    """said(id, name, cell, full, given, family) -> id, name, cell, key of the entity of the full name, if it is known."""
    text = F.concat_ws("|", "given", "family")
    chinese = said.where("full = 'chinese'").select("id", "name", "cell", text.alias("text")).join(leads, ["cell", "text"]).join(letters, ["cell", "letters"], "left")
    latin = said.where("full = 'latin'").select("id", "name", "cell", F.explode(F.array(text, F.concat_ws("|", "family", "given"))).alias("letters")).join(letters, ["cell", "letters"])
    return chinese.select("id", "name", "cell", F.coalesce("key", "lead").alias("key")).unionByName(latin.select("id", "name", "cell", "key"))


def entities_of(spellings: DataFrame, tables: Tables, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spellings(name, n), distinct names with their frequency, listed(id, name, alias) of records -> name, entity; id, name, own.

    A short name that fits no entity or several takes the one entity of the aliases that agree with it; where records of
    one short name differ, each record keeps the one of its own aliases.
    """
    shared = spellings.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, n, *parse(name, shared.value)) for name, n in zip(batch["name"], batch["n"], strict=True)]
            yield pd.DataFrame(rows, columns=["name", "n", "form", "kind", "mark", "given", "family"])

    def romanise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = shared.value
            out = []
            for lead in batch["lead"]:
                given, _, family = lead.partition("|")
                a, b = own.letters(given), own.letters(family)
                out.append(f"{a}|{b}" if a and b else None)
            yield batch.assign(letters=out)

    def neighbours_swapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, out = shared.value, []
            for cell, lead, letters in zip(batch["cell"], batch["lead"], batch["letters"], strict=True):
                for k in range(len(lead) - 1):
                    if letters and "|" not in lead[k : k + 2] and lead[k] != lead[k + 1]:
                        a, _, b = (lead[:k] + lead[k + 1] + lead[k] + lead[k + 2 :]).partition("|")
                        out += [(cell, letters, f"{x}|{y}") for x, y in ((own.letters(a), own.letters(b)), (own.letters(b), own.letters(a)))]
            yield pd.DataFrame(out, columns=["cell", "letters", "text"])

    parsed = stored(spellings.mapInPandas(run, "name string, n long, form string, kind string, mark string, given string, family string"), "parsed")
    cell = F.concat_ws("/", "kind", "mark")
    text = F.concat_ws("|", "given", "family")
    full = parsed.where("form in ('chinese', 'latin')").select("name", "n", "form", cell.alias("cell"), text.alias("text"), "given", "family")
    chinese = full.where("form = 'chinese'").groupBy("cell", "text").agg(F.sum("n").alias("weight"))
    def first_syllables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = shared.value
            yield pd.DataFrame({"cell": batch["cell"], "key": batch["key"], "given": [own.letters(g[:1]) for g in batch["given"]], "family": [own.letters(f) for f in batch["family"]]})

    leads = stored(followed(chinese).mapInPandas(romanise, "cell string, text string, lead string, letters string"), "leads")
    heavy = leads.join(chinese, ["cell", "text"]).where("letters is not null").groupBy("cell", F.col("letters").alias("text")).agg((F.sum("weight") + HEAVY).alias("weight"))
    latin = full.where("form = 'latin'")
    both = latin.select("name", "cell", "text", "n").unionByName(latin.select("name", "cell", F.concat_ws("|", "family", "given").alias("text"), F.lit(0).alias("n")))
    nodes = heavy.unionByName(both.groupBy("cell", "text").agg(F.sum("n").cast("long").alias("weight"))).groupBy("cell", "text").agg(F.max("weight").alias("weight"))
    nodes = stored(nodes, "latin")
    follow = stored(followed(nodes).join(nodes.select("cell", F.col("text").alias("lead"), "weight"), ["cell", "lead"]), "follow")
    letters = follow.select("cell", F.col("text").alias("letters"), F.col("lead").alias("key"))
    # two neighbouring characters that changed places are further apart in letters than the radius
    swapped = leads.mapInPandas(neighbours_swapped, "cell string, letters string, text string").join(letters, ["cell", "letters"]).groupBy("cell", "text").agg(F.min("key").alias("other"), F.max("key").alias("last"))
    follow = follow.join(swapped.where("other = last").select("cell", "text", "other"), ["cell", "text"], "left")
    best = F.max(F.struct("weight", "n", "cell", F.when(F.col("weight") < HEAVY, F.coalesce("other", "lead")).otherwise(F.col("lead")).alias("lead"))).alias("best")
    of_latin = both.join(follow, ["cell", "text"]).groupBy("name").agg(best).select("name", "best.cell", F.col("best.lead").alias("key"))
    of_chinese = (
        full.where("form = 'chinese'").join(leads, ["cell", "text"]).join(letters, ["cell", "letters"], "left").select("name", "cell", F.coalesce("key", "lead").alias("key"))
    )
    # names of any other make: typos and reordered parts, told by the distance of their sorted parts alone
    other = parsed.where("form = 'other'").select("name", "n", F.concat(F.lit("other/"), "mark").alias("cell"), plain_text(F.col("given")).alias("text"))
    told = stored(followed(other.where(F.length("text") >= LEAST).groupBy("cell", "text").agg(F.sum("n").cast("long").alias("weight"))), "other")
    of_other = other.join(told, ["cell", "text"], "left").select("name", "cell", F.coalesce("lead", "text").alias("key"))
    whole = stored(of_latin.unionByName(of_chinese), "whole")
    # initials, nicknames and clipped names: exactly one entity may fit
    people = stored(full.where("form = 'chinese'").join(whole.select("name", "key"), "name").select("cell", "key", "given", "family").distinct(), "people")
    spoken = people.mapInPandas(first_syllables, "cell string, key string, given string, family string").where("given is not null and family is not null")
    written_latin = latin.join(whole.select("name", "key"), "name").select("cell", "key", "given", "family")
    short = parsed.where("form in ('initial', 'nick', 'clipped')").select("name", "form", cell.alias("cell"), F.col("given").alias("piece"), "family")
    clipped = people.select("cell", "key", F.array_sort(F.array(F.substring("given", 1, 2), F.substring("family", 1, 2))).alias("parts"))
    fits = (
        short.where("form <> 'clipped'")
        .join(people, ["cell", "family"])
        .where(F.expr("(form = 'initial' and startswith(given, piece)) or (form = 'nick' and contains(given, piece))"))
        .select("name", "cell", "key")
        .unionByName(short.where("form = 'initial'").join(spoken, ["cell", "family"]).where("given = piece").select("name", "cell", "key"))
        .unionByName(
            short.where("form = 'clipped'")
            .select("name", "cell", F.array("piece", "family").alias("parts"))
            .join(clipped, ["cell", "parts"])
            .select("name", "cell", "key")
        )
    )
    # spellings in letters only decide where no Chinese spelling of the family is known
    rest = short.where("form = 'initial'").join(fits.select("name").distinct(), "name", "left_anti").join(written_latin, ["cell", "family"]).where("startswith(given, piece)")
    fits = fits.unionByName(rest.select("name", "cell", "key")).groupBy("name", "cell").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key = last").select("name", "cell", "key")
    def agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, out = shared.value, []
            for id, name, alias, form, mine, piece, family in batch[["id", "name", "alias", "form", "cell", "piece", "family"]].itertuples(index=False):
                full, kind, mark, *parts = parse(alias, own)
                if full in ("chinese", "latin") and "/".join((kind, mark)) == mine and agrees(form, piece, family, (full, *parts), own):
                    out.append((id, name, mine, full, *parts))
            yield pd.DataFrame(out, columns=["id", "name", "cell", "full", "given", "family"])

    fits = stored(fits, "fits")
    open_names = short.where("form <> 'clipped'").join(fits.select("name"), "name", "left_anti").join(shuffled(listed.where("alias <> ''")), "name")
    said = stored(open_names.mapInPandas(agreeing, "id string, name string, cell string, full string, given string, family string"), "said")
    # the entity of an alias: of the same spelling, else of the same name in characters or letters
    keyed = stored(followed_key(said, leads, letters), "keyed")
    own = keyed.groupBy("id", "name").agg(F.min(F.concat_ws("#", "cell", "key")).alias("own"), F.max(F.concat_ws("#", "cell", "key")).alias("last")).where("own = last").select("id", "name", "own")
    by_alias = keyed.groupBy("name", "cell").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key = last").select("name", "cell", "key")
    fits = fits.unionByName(by_alias)
    known = whole.unionByName(fits).unionByName(of_other.where("key <> ''")).select("name", F.concat_ws("#", "cell", "key").alias("entity"))
    return parsed.select("name").join(known, "name", "left").select("name", F.coalesce("entity", F.concat(F.lit("="), "name")).alias("entity")), own


def show_of(name: str, shows: dict[str, str]) -> str | None:
    """The id of the one show whose name or alias a spelling is near to. shows: folded spelling -> id."""
    t = folded(name).lower()
    if GENERATION.search(t):
        return None
    forms = {t, t.replace(" ", ""), re.sub("^(?:动画片|动画|电视剧|节目)", "", t)}
    forms |= {f.replace("之", "", 1) for f in forms} | {b + a for f in forms for a, s, b in [f.partition("·")] if s}
    exact = {shows[f] for f in forms if f in shows}
    if len(exact) == 1:
        return exact.pop()
    found = {i for f in forms for x, i in shows.items() if len(x) >= 4 and near(f, x)}
    return found.pop() if len(found) == 1 else None


def same_entities(records: DataFrame, ends: DataFrame, shows: DataFrame) -> DataFrame:
    """records(id, name, aliases), ends(key, name), shows(id, name, aliases) -> left_key, right_key, smaller first."""
    spark = records.sparkSession
    records = records.select("id", "name", "aliases")
    ends = ends.where("name <> ''").select("key", "name")
    tables = learnt(records.select("name", "aliases").unionByName(ends.select("name", F.lit(None).cast("array<string>").alias("aliases"))))
    spellings = records.where("name <> ''").select("name").union(ends.select("name")).groupBy("name").agg(F.count("*").alias("n"))
    aliases = records.where("name <> ''").select("id", "name", F.explode("aliases").alias("alias")).distinct()
    entity, own = entities_of(spellings, tables, aliases)
    entity = stored(entity, "entities")
    named = records.where("name <> ''").select("id", "name").distinct().join(entity, "name").join(own, ["id", "name"], "left")
    owners = stored(named.select("id", F.coalesce("own", "entity").alias("entity")).distinct(), "owners")
    pairs = owners.alias("x").join(owners.alias("y"), "entity").where("x.id < y.id").select(F.col("x.id").alias("left_key"), F.col("y.id").alias("right_key"))
    listed = (
        records.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).join(owners, "id").select("entity", "name").distinct()
    )
    unlisted = entity.join(owners.select("entity").distinct(), "entity", "left_semi").join(listed, ["entity", "name"], "left_anti")
    linked = ends.join(shuffled(unlisted), "name").join(owners, "entity").select("key", "id")
    forms = shows.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).where("form <> ''")
    rows = shows.select("id", "name", "aliases").limit(SHOWS + 1).collect()
    if len(rows) > SHOWS:
        raise ValueError(f"more than {SHOWS} shows")
    known = {folded(x).lower(): r.id for r in rows for x in (r.name, *(r.aliases or [])) if x}
    shared = spark.sparkContext.broadcast(known)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, i) for name in batch["name"] if (i := show_of(name, shared.value))]
            yield pd.DataFrame(rows, columns=["name", "id"])

    shown = ends.select("name").distinct().join(forms.select(F.col("form").alias("name")), "name", "left_anti").mapInPandas(match, "name string, id string")
    linked = linked.unionByName(ends.join(shown, "name").select("key", "id"))
    out = pairs.unionByName(linked.select(F.least("id", "key").alias("left_key"), F.greatest("id", "key").alias("right_key")))
    return out.distinct()


def triple_ends(triples: DataFrame) -> DataFrame:
    subject = triples.select(F.concat("triple_id", F.lit(":s")).alias("key"), F.col("subject").alias("name"))
    thing = triples.where("relation <> 'ALIAS' and object_type <> 'Literal'").select(F.concat("triple_id", F.lit(":o")).alias("key"), F.col("object").alias("name"))
    return subject.unionByName(thing)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_entities(table(spark, sf_dir, "entities"), triple_ends(table(spark, sf_dir, "triples")), table(spark, sf_dir, "shows"))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
