"""Facts by rules: patterns per type of page, lists of members, and the chain of checks behind them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import extraction as X

#: What the titles of the archive's pages carry after the name of their subject. A parameter of `facts`.
SUFFIXES = (" 角色资料", "（人物）", "名册", " 团体页", " 剧集简介")
#: Rules of the archive's pages: types of page, relation, pattern. The groups are subject and object; an empty one is the
#: page's own subject. A parameter of `facts`.
RULES = [
    *(("profile", relation, "()" + pattern) for relation, pattern in X.PATTERNS),
    ("profile", "COUSIN_OF", "()论亲戚，此角色是([^。\n]+)的表亲。"), ("profile", "PARENT_OF", "()此角色是([^。\n]+)的家长。"), ("profile", "UNCLE_OF", "()此角色是([^。\n]+)的叔父。"),
    ("profile", "LIKES", "()此角色暗暗喜欢([^。\n]+)。"), ("profile", "FRIEND_OF", "()此角色与([^。\n]+)交情极好。"), ("profile", "FRIEND_OF", "()说起知己，此角色只认([^。\n]+)。"),
    ("profile", "PARTNER_OF", "()此角色外出时与([^。\n]+)搭档。"), ("profile", "STUDENT_OF", "()此角色曾在([^。\n]+)念书。"), ("profile", "LEADER_OF", "()此角色是([^。\n]+)的领头人。"),
    ("profile", "MEMBER_OF", "()此角色加入([^。\n]+)已有多年。"), ("profile", "MEMBER_OF", "()此角色登记在([^。\n]+)名下。"), ("profile", "WISHED_ON", "()此角色曾对着([^。\n]+)许愿。"),
    ("profile", "ROLE", "()镇上的人都知道此角色是([^。\n]+)。"), ("profile", "ALIAS", "资料室旧卡片注明，([^。，\n]+)又写作([^。\n]+)。"),
    ("show_intro", "FIRST_AIRED", "《([^》\n]+)》于([^。\n]+)首次播出。"), ("show_intro", "BROADCASTER", "()首播平台是([^。\n]+)。"), ("show_intro", "EPISODES", "()全剧共 ([^。\n]+)。"),
    ("show_intro", "THEME_SONG", "()片头曲名为《([^》\n]+)》。"), ("group", "LEADER_OF", "领头的是([^。\n]+)()。"),
    ("story", "STUDENT_OF", "([^。，”“　\n]+)在([^。，\n]+)念过书。"), ("story", "WISHED_ON", "众人都说([^。\n]+)曾对着([^。\n]+)许愿。"), ("story", "SEALED_BY", "([^。，”“　\n]+)被([^。，\n]+)关进了[^。\n]+。"),
]
#: Ends of the names of listed places and groups, and what their members do there; others are lived in. A parameter of `listed`.
LISTS = [("STUDENT_OF", "(?:学堂|学校)$"), ("MEMBER_OF", "[会团队组社]$")]
#: Stories and settings share their rules.
KIN = {"setting": "story"}


def title_entity(title: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The subject of a page from its title: every suffix goes, wherever it stands."""
    out = F.coalesce(title, F.lit(""))
    for s in suffixes:
        out = F.replace(out, F.lit(s), F.lit(""))
    return F.trim(out)


def facts(documents: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """documents(id, doc_type, title, text) -> id, relation, subject, object, evidence for every match of the page's rules.

    One scan; every pattern is a constant and is compiled once. Facts without a subject or object are left out.
    """
    scope = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in KIN.items() for x in pair)), F.col("doc_type")), F.col("doc_type"))
    rows = documents.where(F.length("text") > 0).select("id", "text", title_entity(F.col("title")).alias("me"), scope.alias("scope"))
    none = F.array().cast("array<struct<relation:string,s:string,o:string,e:string>>")

    def of(kind: str, relation: str, pattern: str) -> Column:
        # a text without the pattern's longest constant part can't match: a cheap test before a search that may be dear
        sure = max(re.split(r"\(\)|\(?\[\^[^\]]*\]\+\)?", pattern), key=len)
        found = [F.regexp_extract_all("text", F.lit(pattern), F.lit(k)) for k in (1, 2, 0)]
        hits = F.transform(F.arrays_zip(found[0].alias("s"), found[1].alias("o"), found[2].alias("e")), lambda m: F.struct(F.lit(relation).alias("relation"), m["s"].alias("s"), m["o"].alias("o"), m["e"].alias("e")))
        return F.when((F.col("scope") == kind) & F.contains("text", F.lit(sure)), hits).otherwise(none)

    hits = rows.select("id", "me", F.explode(F.flatten(F.array(*(of(*r) for r in rules)))).alias("m")).select("id", "me", F.col("m.relation").alias("relation"), "m")
    end = lambda c: F.when(F.col(c) == "", F.col("me")).otherwise(F.trim(c))
    out = hits.select("id", "relation", end("m.s").alias("subject"), end("m.o").alias("object"), F.col("m.e").alias("evidence"))
    return out.where("subject <> '' and object <> ''").distinct()


def listed(documents: DataFrame, lists: list[tuple[str, str]] = LISTS) -> DataFrame:
    """Facts of rosters (a heading, then items) and of the members that group pages name: id, relation, subject, object, evidence."""
    rows = documents.where(F.length("text") > 0).select("id", "doc_type", "text", title_entity(F.col("title")).alias("me")).where("me <> ''")
    blocks = F.split("text", r"\n(?=[一二三四五六七八九十]+、)")
    sections = rows.where("doc_type = 'roster'").select("id", "me", F.explode(F.filter(blocks, lambda b: b.rlike("^[一二三四五六七八九十]+、"))).alias("b"))
    items = sections.select("id", "me", F.regexp_extract("b", r"^[一二三四五六七八九十]+、([^\n]*)", 1).alias("head"), F.explode(F.regexp_extract_all("b", F.lit(r"·[ 　]*([^\n]+)"), F.lit(1))).alias("name"))
    relation = F.lit("LIVES_IN")
    for name, pattern in reversed(lists):
        relation = F.when(F.col("me").rlike(pattern), name).otherwise(relation)
    roster = items.select("id", relation.alias("relation"), F.trim("name").alias("subject"), F.col("me").alias("object"), F.concat_ws(" · ", F.trim("head"), F.trim("name")).alias("evidence"))
    named = rows.where("doc_type = 'group'").select("id", "me", F.explode(F.regexp_extract_all("text", F.lit("成员有([^。\n]+)。"), F.lit(1))).alias("all"))
    group = named.select("id", "me", "all", F.explode(F.split("all", "[、和]")).alias("name")).select("id", F.lit("MEMBER_OF").alias("relation"), F.trim("name").alias("subject"), F.col("me").alias("object"), F.concat(F.lit("成员有"), "all", F.lit("。")).alias("evidence"))
    return roster.unionByName(group).where("subject <> ''").distinct()


def checked(found: DataFrame, documents: DataFrame) -> DataFrame:
    """found(id, relation, subject, object, evidence) after the chain of checks: names and relation, evidence in the text, then the
    first of equal facts of one document. Types come from the schema. Adds `reason` (ok, empty_name, unknown_relation, no_evidence)."""
    schema = F.broadcast(X.schema_frame(found.sparkSession))
    rows = found.join(schema, "relation", "left").join(documents.select("id", F.col("text").alias("body")), "id")
    reason = (
        F.when((F.trim("subject") == "") | (F.trim("object") == ""), "empty_name")
        .when(F.col("want_subject").isNull(), "unknown_relation")
        .when(~X.verbatim(F.col("evidence"), F.col("body")), "no_evidence")
        .otherwise("ok")
    )
    rows = rows.withColumn("reason", reason).select("id", "relation", "subject", F.col("want_subject").alias("subject_type"), "object", F.col("want_object").alias("object_type"), "evidence", "reason")
    return rows.groupBy("id", "relation", "subject", "object", "subject_type", "object_type", "reason").agg(F.min("evidence").alias("evidence"))
