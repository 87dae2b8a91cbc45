"""Graph retrieval for batches of questions: relation words, templates, walks, documents, chunks; routed cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R
from quillgraph.plans import shuffled, written

#: Words of a question and the relations that they ask for.
RELATION_WORDS = {
    "爸爸": ("PARENT_OF",), "妈妈": ("PARENT_OF",), "父亲": ("PARENT_OF",),
    "母亲": ("PARENT_OF",), "儿子": ("PARENT_OF",), "女儿": ("PARENT_OF",),
    "爷爷": ("PARENT_OF", "GRANDPARENT_OF"), "奶奶": ("PARENT_OF", "GRANDPARENT_OF"),
    "外公": ("PARENT_OF", "GRANDPARENT_OF"), "外婆": ("PARENT_OF", "GRANDPARENT_OF"),
    "代孙": ("DESCENDANT_OF", "PARENT_OF"),
    "老婆": ("SPOUSE_OF",), "妻子": ("SPOUSE_OF",), "老公": ("SPOUSE_OF",),
    "丈夫": ("SPOUSE_OF",), "岳父": ("SPOUSE_OF", "PARENT_OF"),
    "岳母": ("SPOUSE_OF", "PARENT_OF"),
    "表哥": ("COUSIN_OF",), "表妹": ("COUSIN_OF",), "表姐": ("COUSIN_OF",),
    "表弟": ("COUSIN_OF",), "表姨": ("COUSIN_OF", "PARENT_OF"),
    "二叔": ("UNCLE_OF",), "叔叔": ("UNCLE_OF",), "侄子": ("UNCLE_OF",),
    "搭档": ("PARTNER_OF",),
    "大哥": ("LEADER_OF", "MEMBER_OF"), "老大": ("LEADER_OF", "MEMBER_OF"),
    "首领": ("LEADER_OF",), "成员": ("MEMBER_OF",), "组成": ("MEMBER_OF",),
    "喜欢": ("LIKES",), "好朋友": ("FRIEND_OF",),
    "校长": ("HEAD_OF",), "村长": ("HEAD_OF",), "当家": ("HEAD_OF",),
    "上学": ("STUDENT_OF",), "学生": ("STUDENT_OF",),
    "住着": ("LIVES_IN",), "住在": ("LIVES_IN",),
    "坐落": ("LOCATED_IN",), "位于": ("LOCATED_IN",),
    "封印": ("SEALED_BY", "RELEASED_BY"),
    "许愿": ("WISHED_ON",),
    "原型": ("PROTOTYPE",), "武器": ("WEAPON",), "兵器": ("WEAPON",),
    "爱吃": ("FAVORITE_FOOD",), "口头禅": ("CATCHPHRASE",),
    "职务": ("ROLE",), "身份": ("ROLE",), "做什么": ("ROLE",), "干什么": ("ROLE",),
    "必杀技": ("SPECIAL_MOVE",), "编号": ("UNIT_NO",), "号机": ("UNIT_NO",),
    "变换": ("TRANSFORM_TIME",), "变身": ("TRANSFORM_TIME",),
    "巨人": ("GIANT_FORM",), "阵营": ("FACTION",), "生日": ("BIRTHDAY",),
}
#: Hops of a chain and of a neighbourhood or path, paths of a pair, documents of a question.
CHAIN_HOPS, MAX_HOPS, MAX_PATHS, MAX_DOCS = 3, 4, 12, 40


def question_relations(questions: DataFrame) -> DataFrame:
    """questions(query, text) -> query, relations: what their words ask for, sorted."""
    words = F.array(*(F.struct(F.lit(w).alias("word"), F.array(*(F.lit(r) for r in rs)).alias("relations")) for w, rs in RELATION_WORDS.items()))
    asked = F.filter(words, lambda w: F.contains(F.col("text"), w["word"]))
    return questions.select("query", F.array_sort(F.array_distinct(F.flatten(F.transform(asked, lambda w: w["relations"])))).alias("relations"))


def templates(questions: DataFrame, seeds: DataFrame) -> DataFrame:
    """questions(query, text), seeds(query, node) -> query, seeds, relations, template of the questions with a seed."""
    n = seeds.groupBy("query").agg(F.countDistinct("node").alias("seeds"))
    rows = questions.join(n, "query").join(question_relations(questions), "query")
    path = (F.col("seeds") >= 2) & F.col("text").rlike("|".join(R.PATH_HINTS))
    return rows.select("query", "seeds", "relations", F.when(path, "relation_path").when(F.size("relations") > 0, "relation_chain").otherwise("neighborhood").alias("template"))


def seeds_of(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """questions(query, text), entities(id, name, aliases) -> query, node (the entity's name), place, each node once."""
    linked = R.linked(questions, R.surface_forms(entities)).join(shuffled(entities.select(F.col("id").alias("entity"), F.col("name").alias("node"))), "entity").where("node <> ''")
    return linked.groupBy("query", "node").agg(F.min("place").alias("place"))


def _path_hits(edges: DataFrame, seeds: DataFrame, plan: DataFrame) -> DataFrame:
    own = seeds.join(plan.where("template = 'relation_path'").select("query"), "query")
    pairs = own.alias("x").join(own.alias("y"), "query").where("x.place < y.place")
    pairs = pairs.select(F.concat_ws("|", "query", "x.place", "y.place").alias("pair"), "query", F.col("x.node").alias("source"), F.col("y.node").alias("target"))
    found = G.paths(edges, pairs.select("pair", "source", "target"), MAX_HOPS, MAX_PATHS).join(pairs.select("pair", "query"), "pair")
    return found.select("query", F.col("hops").alias("hop"), F.explode(F.transform("order", lambda s: s["seq"])).alias("seq"))


def _walk_hits(edges: DataFrame, seeds: DataFrame, plan: DataFrame) -> DataFrame:
    """plan(query, relations or null, most) -> query, hop, seq of every edge seen on the way.

    Each level is written. A question's visited nodes are shared by its seeds; hubs are seen, not entered. Where relations are asked for, the
    appearances of the nodes that were reached follow one hop later.
    """
    steps, hubs = G.steps_of(edges), G.degrees(edges).where("hub").select(F.col("node").alias("other"))
    front = seeds.select("query", "node").distinct().join(plan.select("query", "relations", "most"), "query").select("query", "node", "relations", "most", F.lit(0).alias("hop"))
    seen, hits = front, None
    for hop in range(1, MAX_HOPS + 1):
        taken = front.where((F.col("most") >= hop) & ~F.col("node").startswith("lit:")).join(steps, "node")
        taken = taken.where(F.col("relations").isNull() | F.array_contains("relations", F.col("rel"))).select("query", "relations", "most", "other", F.lit(hop).alias("hop"), "seq").distinct()
        taken = written(taken, "taken")
        hits = taken.select("query", "hop", "seq") if hits is None else hits.unionByName(taken.select("query", "hop", "seq"))
        new = taken.select("query", "relations", "most", F.col("other").alias("node")).distinct().join(hubs.withColumnRenamed("other", "node"), "node", "left_anti")
        if hop == MAX_HOPS:
            new = new.where("relations is not null")
        front = written(new.join(seen.select("query", "node"), ["query", "node"], "left_anti").select("query", "node", "relations", "most", F.lit(hop).alias("hop")), "front")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    shows = edges.where("rel = 'APPEARS_IN'").select(F.col("src").alias("node"), "seq")
    late = seen.where("hop > 0 and relations is not null").join(shows, "node").select("query", (F.col("hop") + 1).alias("hop"), "seq", F.lit(True).alias("late"))
    return hits.withColumn("late", F.lit(False)).unionByName(late)


def graph_documents(edges: DataFrame, seeds: DataFrame, plan: DataFrame) -> DataFrame:
    """edges, seeds(query, node, place), plan as of `templates` -> query, template, doc, hop, nodes: the first documents by hop, then id.

    A document's hop is that of its first hit, its nodes are the ends of all edges that hit it. A question whose template
    finds nothing falls back to its neighbourhood.
    """
    edges, seeds, plan = written(edges, "edges"), written(seeds, "seeds"), written(plan, "plan")
    whole = edges.select("seq", "src", "dst", F.concat(F.array("source_doc"), "extra_docs").alias("docs"))
    chain = plan.where("template = 'relation_chain'").select("query", "relations", F.lit(CHAIN_HOPS).alias("most"))
    around = lambda p: p.select("query", F.lit(None).cast("array<string>").alias("relations"), F.lit(MAX_HOPS).alias("most"))
    walks = _walk_hits(edges, seeds, chain.unionByName(around(plan.where("template = 'neighborhood'"))))
    first = walks.unionByName(_path_hits(edges, seeds, plan).withColumn("late", F.lit(False))).join(whole, "seq").withColumn("template", F.lit(None).cast("string"))
    hits = written(first.select("query", "template", "hop", "late", "src", "dst", F.explode("docs").alias("doc")).where("doc is not null"), "hits")
    lost = written(plan.where("template <> 'neighborhood'").join(hits.select("query").distinct(), "query", "left_anti"), "lost")
    if not lost.isEmpty():
        back = _walk_hits(edges, seeds, around(lost)).join(whole, "seq").withColumn("template", F.lit("neighborhood(fallback)"))
        hits = hits.unionByName(back.select("query", "template", "hop", "late", "src", "dst", F.explode("docs").alias("doc")).where("doc is not null"))
    # appearances count only for documents that no other edge hit
    own = Window.partitionBy("query", "doc")
    hits = hits.withColumn("plain", F.min("late").over(own)).where("late = plain")
    docs = hits.groupBy("query", "doc").agg(F.max("template").alias("fallback"), F.min("hop").alias("hop"), F.array_sort(F.array_union(F.collect_set("src"), F.collect_set("dst"))).alias("nodes"))
    docs = docs.join(plan.select("query", "template"), "query").withColumn("template", F.coalesce("fallback", "template"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("hop", "doc"))
    return written(docs.withColumn("n", place).where(F.col("n") <= MAX_DOCS).select("query", "template", "doc", "hop", "nodes"), "documents")


def erased(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """texts(query, text), forms(form, entity) -> query, text without the forms, the longest taken out first."""
    found = R.mentions(texts, forms).groupBy("query").agg(F.array_sort(F.collect_set(F.struct((-F.length("form")).alias("n"), "form"))).alias("gone"))
    rows = texts.join(found, "query", "left")
    out = F.aggregate(F.coalesce("gone", F.array().cast("array<struct<n:int,form:string>>")), F.col("text"), lambda t, g: F.replace(t, g["form"], F.lit("")))
    return rows.select("query", out.alias("text"))


def graph_chunks(documents: DataFrame, edges: DataFrame, entities: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """documents as of `graph_documents`, chunks(item, doc, seq, text) -> query, item, score, rank: one chunk of each document in turn.

    In a document those chunks come first that name most of the hit's nodes; the names of hubs are erased before, the page's
    own subject doesn't count.
    """
    edges = written(edges, "edges")
    hubs = written(G.degrees(edges).where("hub").select("node"), "hubs")
    named = entities.where("name <> ''").select(F.col("name").alias("node"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).where("form <> ''").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    literal = ends.where("startswith(node, 'lit:')").select("node", F.expr("substring(node, 5)").alias("form"))
    plain = ends.where("not startswith(node, 'lit:')").select("node", F.col("node").alias("form"))
    forms = literal.unionByName(plain).unionByName(named).where("form <> ''").distinct()
    focus = documents.select("query", "doc", F.explode("nodes").alias("node")).join(hubs, "node", "left_anti").join(forms, "node").select("query", "doc", "form").distinct()
    docs = edges.where("rel = 'APPEARS_IN'").select("seq", F.col("src").alias("node"), F.explode(F.concat(F.array("source_doc"), "extra_docs")).alias("doc"))
    owner = docs.groupBy("doc").agg(F.min_by("node", "seq").alias("node")).join(forms, "node").select("doc", "form")
    focus = focus.join(owner, ["doc", "form"], "left_anti").groupBy("query", "doc").agg(F.collect_set("form").alias("focus"))
    own = chunks.join(documents.select("doc").distinct(), "doc", "left_semi")
    hub_forms = forms.join(hubs, "node", "left_semi").groupBy("form").agg(F.min("node").alias("entity"))
    clean = erased(own.select(F.col("item").alias("query"), "text"), hub_forms.where(F.length("form") >= 2)).select(F.col("query").alias("item"), "text")
    rows = documents.select("query", "doc", "hop").join(own.select("doc", "item", "seq"), "doc").join(clean, "item").join(focus, ["query", "doc"], "left")
    named_here = F.size(F.filter(F.coalesce("focus", F.array().cast("array<string>")), lambda f: F.contains(F.col("text"), f)))
    turn = F.row_number().over(Window.partitionBy("query", "doc").orderBy(F.desc("named"), "seq", "item")) - 1
    rows = rows.withColumn("named", named_here).withColumn("turn", turn)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("turn", "hop", "doc"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.select("query", "item", F.round(F.lit(1.0) / F.col("hop") - F.col("turn") * F.lit(0.0001).cast("double"), 6).alias("score"), "rank")


def trace(documents: DataFrame, seeds: DataFrame) -> DataFrame:
    """query, template, linked nodes in order, number of documents, the first twelve of them."""
    linked = seeds.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda s: s["node"]).alias("linked"))
    hits = documents.groupBy("query", "template").agg(F.count("*").alias("documents"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("hop", "doc"))), lambda s: s["doc"]), 1, 12).alias("first"))
    return linked.join(hits, "query", "left").select("query", "template", "linked", F.coalesce("documents", F.lit(0)).alias("documents"), "first")


def routed_cascade(routes: DataFrame, graph: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """routes(query, route), two ranked lists -> query, route, item, stage, score, place.

    The list that the route names gives the first half of k, the other one fills up; what it adds scores below zero.
    """
    way = routes.select("query", "route")
    side = lambda ranked, route, same: ranked.join(way, "query").where((F.col("route") == route) if same else (F.col("route") != route)).select("query", "item", "rank")
    primary = side(graph, "graph", True).unionByName(side(lexical, "graph", False))
    backup = side(lexical, "graph", True).unionByName(side(graph, "graph", False))
    merged = R.cascade(primary, backup, k)
    scores = primary.select("query", "item", F.lit(0).alias("stage"), (F.lit(1.0) / F.col("rank")).alias("score")).unionByName(
        backup.select("query", "item", F.lit(1).alias("stage"), (F.lit(-1.0) - (F.col("rank") - 1) * F.lit(0.001).cast("double")).alias("score"))
    )
    return merged.join(scores, ["query", "item", "stage"]).join(way, "query").select("query", "route", "item", "stage", F.round("score", 6).alias("score"), "place")
