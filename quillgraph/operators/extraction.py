"""Documents to triples: patterns, the relation schema, evidence, mentions, resolution under cannot-link constraints."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T

#: The relations and the types of their ends.
RELATIONS = {
    "APPEARS_IN": ("Character", "Show"), "PARENT_OF": ("Character", "Character"), "GRANDPARENT_OF": ("Character", "Character"), "SPOUSE_OF": ("Character", "Character"),
    "COUSIN_OF": ("Character", "Character"), "UNCLE_OF": ("Character", "Character"), "DESCENDANT_OF": ("Character", "Character"), "LIKES": ("Character", "Character"),
    "FRIEND_OF": ("Character", "Character"), "PARTNER_OF": ("Character", "Character"), "SEALED_BY": ("Character", "Character"), "RELEASED_BY": ("Character", "Character"),
    "HEAD_OF": ("Character", "Place"), "LIVES_IN": ("Character", "Place"), "STUDENT_OF": ("Character", "Place"), "LOCATED_IN": ("Place", "Place"),
    "MEMBER_OF": ("Character", "Group"), "LEADER_OF": ("Character", "Group"), "WISHED_ON": ("Character", "Item"), "ALIAS": ("Character", "Literal"),
    "UNIT_NO": ("Character", "Literal"), "PROTOTYPE": ("Character", "Literal"), "ROLE": ("Character", "Literal"), "BIRTHDAY": ("Character", "Literal"),
    "CATCHPHRASE": ("Character", "Literal"), "WEAPON": ("Character", "Literal"), "SPECIAL_MOVE": ("Character", "Literal"), "FAVORITE_FOOD": ("Character", "Literal"),
    "CARRIES": ("Character", "Literal"), "TRANSFORM_TIME": ("Character", "Literal"), "GIANT_FORM": ("Character", "Literal"), "FACTION": ("Character", "Literal"),
    "FIRST_AIRED": ("Show", "Literal"), "BROADCASTER": ("Show", "Literal"), "EPISODES": ("Show", "Literal"), "THEME_SONG": ("Show", "Literal"),
    "FIRST_MOVIE": ("Show", "Literal"), "QUANTITY": ("Item", "Literal"),
}
#: Patterns of the archive's pages: relation and regular expression with the object as its group. A parameter of `extracted`.
PATTERNS = [
    ("UNIT_NO", "此角色的机号为([^。\n]+)。"), ("UNIT_NO", "出厂铭牌上的机号是([^。\n]+)。"), ("WEAPON", "此角色最顺手的武器是([^。\n]+)。"), ("WEAPON", "遇上麻烦时，此角色会抄起([^。\n]+)。"),
    ("ROLE", "此角色平日的身份是([^。\n]+)。"), ("CARRIES", "此角色口袋里常备([^。\n]+)。"), ("SPECIAL_MOVE", "此角色的绝招名为([^。\n]+)。"), ("TRANSFORM_TIME", "每次变身最多维持([^。\n]+)。"),
    ("PROTOTYPE", "此角色以([^。\n]+)为原型设计。"), ("BIRTHDAY", "此角色的生日记作([^。\n]+)。"), ("FAVORITE_FOOD", "此角色百吃不厌的是([^。\n]+)。"), ("CATCHPHRASE", "此角色总把“([^”\n]+)”挂在嘴边"),
    ("ALIAS", "此角色另有称呼“([^”\n]+)”"), ("ALIAS", "旁人也叫此角色“([^”\n]+)”"), ("APPEARS_IN", "此角色在《([^》\n]+)》中登场"), ("LIVES_IN", "此角色常年住在([^。\n]+)。"),
]
#: Least share of an evidence part that must be found at one place of the text.
OVERLAP = 0.82
#: Rows of a group of blocks of `constrained_clusters`, on average.
GROUP = 2000


def schema_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, s, o) for r, (s, o) in RELATIONS.items()], "relation string, want_subject string, want_object string")


def extracted(documents: DataFrame, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    """documents(id, text) -> id, relation, object for every match of every pattern; one scan, the pattern is a column."""
    table = F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(p).alias("pattern")) for r, p in patterns))
    rows = documents.where(F.length("text") > 0).select("id", "text", F.explode(table).alias("p"))
    hits = rows.select("id", F.col("p.relation").alias("relation"), F.explode(F.regexp_extract_all("text", F.col("p.pattern"), F.lit(1))).alias("object"))
    return hits.select("id", "relation", F.trim("object").alias("object")).where("object <> ''").distinct()


def tagged(triples: DataFrame) -> DataFrame:
    """Adds `reason`: ok, empty_name, unknown_relation or wrong_type. Rows are tagged, not dropped."""
    known = triples.join(F.broadcast(schema_frame(triples.sparkSession)), "relation", "left")
    reason = (
        F.when(F.coalesce(F.trim("subject"), F.lit("")) == "", "empty_name")
        .when(F.coalesce(F.trim("object"), F.lit("")) == "", "empty_name")
        .when(F.col("want_subject").isNull(), "unknown_relation")
        .when(~F.col("subject_type").eqNullSafe(F.col("want_subject")) | ~F.col("object_type").eqNullSafe(F.col("want_object")), "wrong_type")
        .otherwise("ok")
    )
    return known.withColumn("reason", reason).drop("want_subject", "want_object")


def first_facts(triples: DataFrame) -> DataFrame:
    """Of equal (subject, relation, object) of one document the first row."""
    order = Window.partitionBy("source_doc", "subject", "relation", "object").orderBy("triple_id")
    return triples.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def evidence_parts(evidence: Column) -> Column:
    """The parts of two characters or more of an evidence without spaces; without such a part the whole; none if it is empty."""
    whole = T.without_space(F.coalesce(evidence, F.lit("")))
    parts = F.filter(F.transform(F.split(F.coalesce(evidence, F.lit("")), r"[·•|+；;…]|\.\.\."), T.without_space), lambda p: F.length(p) >= 2)
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(whole)).otherwise(parts)


def verbatim(evidence: Column, text: Column) -> Column:
    """Whether all parts of an evidence stand in a text; an empty evidence does."""
    body = T.without_space(F.coalesce(text, F.lit("")))
    return F.forall(evidence_parts(evidence), lambda p: F.contains(body, p))


def evidenced(triples: DataFrame, documents: DataFrame) -> DataFrame:
    """triples with evidence and document: triple_id, parts, found, verbatim (all parts occur).

    The parts of one document's triples are gathered before its text is joined, once.
    """
    parts = triples.select("triple_id", "source_doc", evidence_parts(F.col("evidence")).alias("ps")).groupBy("source_doc").agg(F.collect_list(F.struct("triple_id", "ps")).alias("t"))
    rows = parts.join(documents.select(F.col("id").alias("source_doc"), T.without_space(F.coalesce("text", F.lit(""))).alias("body")), "source_doc")
    counted = F.transform("t", lambda t: F.struct(t["triple_id"].alias("triple_id"), F.size(t["ps"]).alias("parts"), F.size(F.filter(t["ps"], lambda p: F.contains(F.col("body"), p))).alias("found")))
    return rows.select(F.inline(counted)).withColumn("verbatim", F.col("found") == F.col("parts"))


def nearly_evidenced(triples: DataFrame, documents: DataFrame, least: float = OVERLAP) -> DataFrame:
    """triple_id, accepted of the rows whose evidence isn't verbatim: the longest common run must cover `least` of each part."""
    weak = evidenced(triples, documents).where("not verbatim").select("triple_id")
    rows = triples.join(weak, "triple_id").select("triple_id", "source_doc", "evidence").join(documents.select(F.col("id").alias("source_doc"), "text"), "source_doc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for batch in batches:
            out = []
            for key, evidence, text in zip(batch["triple_id"], batch["evidence"], batch["text"], strict=True):
                body = re.sub(r"\s+", "", text or "")
                parts = [p for x in re.split(r"[·•|+；;…]|\.\.\.", evidence or "") if len(p := re.sub(r"\s+", "", x)) >= 2] or [re.sub(r"\s+", "", evidence or "")]
                ok = all(p in body or SequenceMatcher(None, p, body).find_longest_match(0, len(p), 0, len(body)).size / len(p) >= least for p in parts)
                out.append((key, ok))
            yield pd.DataFrame(out, columns=["triple_id", "accepted"])

    return rows.mapInPandas(run, "triple_id string, accepted boolean")


def mentions(triples: DataFrame) -> DataFrame:
    """name, type of the last mention, context: the first evidence, at most 120 characters."""
    ends = triples.select("triple_id", F.lit(0).alias("end"), F.col("subject").alias("name"), F.col("subject_type").alias("type"), "evidence").unionByName(
        triples.where("object_type <> 'Literal'").select("triple_id", F.lit(1).alias("end"), F.col("object").alias("name"), F.col("object_type").alias("type"), "evidence")
    )
    seq = F.struct("triple_id", "end")
    return ends.where("name <> ''").groupBy("name").agg(F.max_by("type", seq).alias("type"), F.min_by(F.substring(F.coalesce("evidence", F.lit("")), 1, 120), seq).alias("context"))


def name_pairs(entities: DataFrame) -> DataFrame:
    """Pairs of different names of one type that aren't incompatible: a, b, type, verdict.

    The two first characters of the normal form are an equi key: pairs without it are incompatible anyway.
    """
    names = entities.where("name <> '' and entity_type is not null").select("entity_type", "name").distinct().withColumn("head", F.substring(T.normal_name(F.col("name")), 1, 2))
    pairs = names.alias("x").join(names.alias("y"), ["entity_type", "head"]).where("x.name < y.name")
    pairs = pairs.select("entity_type", F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    return pairs.withColumn("verdict", T.lexical_verdict(F.col("a"), F.col("b"))).where("verdict <> 'incompatible'")


def same_names(entities: DataFrame) -> DataFrame:
    """entity_type, norm, representative (longest name, then smallest), names: one row per normal form with several names."""
    names = entities.where("name <> '' and entity_type is not null").select("entity_type", "name").distinct().withColumn("norm", T.normal_name(F.col("name")))
    grouped = names.where("norm <> ''").groupBy("entity_type", "norm").agg(F.count("*").alias("names"), F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("best"))
    return grouped.where("names > 1").select("entity_type", "norm", F.col("best.name").alias("representative"), "names")


def constrained_clusters(candidates: DataFrame) -> DataFrame:
    """candidates(block, a, b, seq, forbid) -> block, name, representative.

    Within a block, rows are taken in order of seq: a forbidding row keeps two clusters apart for good, another one joins
    them unless a forbidden pair would meet. Order matters, so a block is one group; blocks must be closed under joining
    (connected candidates) and run in parallel.
    """

    def clusters(group: pd.DataFrame) -> list[tuple[str, str, str]]:
        up: dict[str, str] = {}
        foes: dict[str, set[str]] = {}

        def root(x: str) -> str:
            up.setdefault(x, x)
            while up[x] != x:
                x = up[x]
            return x

        for a, b, forbid in group.sort_values("seq", kind="stable")[["a", "b", "forbid"]].itertuples(index=False):
            x, y = root(a), root(b)
            if x == y:
                continue
            if forbid:
                foes.setdefault(x, set()).add(y)
                foes.setdefault(y, set()).add(x)
            elif y not in foes.get(x, ()):
                keep, gone = (x, y) if len(x) >= len(y) else (y, x)
                up[gone] = keep
                for z in foes.pop(gone, set()):
                    foes.setdefault(keep, set()).add(z)
                    foes[z].discard(gone)
                    foes[z].add(keep)
        return [(group["block"].iloc[0], n, root(n)) for n in sorted(up)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([x for _, own in group.groupby("block", sort=False, dropna=False) for x in clusters(own)], columns=["block", "name", "representative"])

    # small blocks share a group, as a group of its own costs more than most blocks
    groups = max(1, candidates.count() // GROUP)
    return candidates.groupBy(F.pmod(F.xxhash64("block"), F.lit(groups))).applyInPandas(run, "block string, name string, representative string")
