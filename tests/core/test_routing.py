import pytest

from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R
from quillgraph.operators import routing as W

#: A small world: Ann is the parent of Ben, Ben partners Cid, Cid lives in Dale; all but Dale appear in the Show, a hub.
EDGES = [
    ("T1", "安妮", "PARENT_OF", "本尼", "Character", "d1"), ("T2", "本尼", "PARTNER_OF", "西德", "Character", "d2"), ("T3", "西德", "LIVES_IN", "山谷", "Place", "d3"),
    ("T4", "安妮", "APPEARS_IN", "剧集", "Show", "d1"), ("T5", "本尼", "APPEARS_IN", "剧集", "Show", "d2"), ("T6", "西德", "APPEARS_IN", "剧集", "Show", "d3"),
    *((f"T{k}", f"路人{k}", "APPEARS_IN", "剧集", "Show", f"d{k}") for k in range(10, 22)),
]


@pytest.fixture(scope="module")
def world(spark):
    edges = G.edges_of(spark.createDataFrame(EDGES, "triple_id string, subject string, relation string, object string, object_type string, source_doc string"))
    names = ["安妮", "本尼", "西德", "山谷", "剧集", *(f"路人{k}" for k in range(10, 22))]
    entities = spark.createDataFrame([(f"E{k:02}", n, ["小安"] if n == "安妮" else []) for k, n in enumerate(names)], "id string, name string, aliases array<string>")
    return edges, entities


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query string, text string")


def test_relations_and_templates(spark, world):
    asked = ask(spark, "小安的儿子的搭档是谁", "安妮和西德有什么关系", "西德", "没有谁")
    assert {r.query: list(r.relations) for r in W.question_relations(asked).collect()} == {"q0": ["PARENT_OF", "PARTNER_OF"], "q1": [], "q2": [], "q3": []}
    seeds = W.seeds_of(asked, world[1])
    assert {(r.query, r.node) for r in seeds.collect()} == {("q0", "安妮"), ("q1", "安妮"), ("q1", "西德"), ("q2", "西德")}
    assert {r.query: r.template for r in W.templates(asked, seeds).collect()} == {"q0": "relation_chain", "q1": "relation_path", "q2": "neighborhood"}


def test_documents(spark, world):
    edges, entities = world
    asked = ask(spark, "小安的儿子的搭档是谁", "安妮和西德有什么关系", "西德", "安妮和路人10有什么关系")
    seeds = W.seeds_of(asked, entities)
    rows = W.graph_documents(edges, seeds, W.templates(asked, seeds)).collect()
    hops = lambda q: {r.doc: r.hop for r in rows if r.query == q}
    # the chain: one step to Ben, two to Cid, and Cid's own page one hop later
    assert hops("q0") == {"d1": 1, "d2": 2, "d3": 3}
    assert hops("q1") == {"d1": 2, "d2": 2}
    # the neighbourhood: the show is reached, not entered
    assert hops("q2") == {"d2": 1, "d3": 1, "d1": 2}
    # no path without the hub: the neighbourhood of both
    assert {r.template for r in rows if r.query == "q3"} == {"neighborhood(fallback)"} and {"d1", "d10"} <= set(hops("q3"))


def test_chunks_and_cascade(spark, world):
    edges, entities = world
    asked = ask(spark, "小安的儿子的搭档是谁")
    seeds = W.seeds_of(asked, entities)
    docs = W.graph_documents(edges, seeds, W.templates(asked, seeds))
    texts = [("c1", "d1", 0, "安妮出现在剧集里"), ("c2", "d1", 1, "她的孩子是本尼"), ("c3", "d2", 0, "本尼的页面"), ("c4", "d2", 1, "搭档是西德"), ("c5", "d3", 0, "西德")]
    chunks = spark.createDataFrame(texts, "item string, doc string, seq int, text string")
    ranked = W.graph_chunks(docs, edges, entities, chunks, 4)
    # one chunk of each document in turn, first the one that names the hit's other end
    assert [(r["item"], r.score) for r in ranked.orderBy("rank").collect()] == [("c2", 1.0), ("c4", 0.5), ("c5", 0.333333), ("c1", 0.9999)]
    routes = spark.createDataFrame([("q0", "graph")], "query string, route string")
    lexical = spark.createDataFrame([("q0", "x1", 1), ("q0", "c2", 2), ("q0", "x2", 3), ("q0", "x3", 4)], "query string, item string, rank int")
    out = [(r["item"], r.stage, r.score) for r in W.routed_cascade(routes, ranked, lexical, 4).orderBy("place").collect()]
    assert out == [("c2", 0, 1.0), ("c4", 0, 0.5), ("x1", 1, -1.0), ("x2", 1, -1.002)]


def test_paths_and_reach(spark, world):
    edges, _ = world
    pair = spark.createDataFrame([("p", "安妮", "西德")], "pair string, source string, target string")
    found = G.paths(edges, pair)
    assert [(r.hops, r.path) for r in found.collect()] == [(2, "安妮 -[PARENT_OF]-> 本尼 -[PARTNER_OF]-> 西德")]
    assert [list(r.docs) for r in G.path_documents(found, edges).collect()] == [["d1", "d2"]]
    shown = G.path_graph(found, edges).first()
    assert sorted(shown.nodes) == sorted(["安妮", "本尼", "西德"]) and [tuple(e) for e in shown.edges] == [("安妮", "PARENT_OF", "本尼"), ("本尼", "PARTNER_OF", "西德")]
    seeds = spark.createDataFrame([("s", "安妮")], "query string, node string")
    near = {r.node: r.hop for r in G.reach(edges, seeds, 2, ["PARENT_OF", "PARTNER_OF"]).collect()}
    assert near == {"安妮": 0, "本尼": 1, "西德": 2}
    goals = spark.createDataFrame([("山谷",), ("西德",)], "node string")
    assert [(r.goal, r.hops) for r in G.paths_to(edges, seeds, goals).collect()] == [("西德", 2)]


def test_mentions_of_any_length(spark):
    long = "长" * 500 + "名"
    forms = spark.createDataFrame([(f"名{'甲' * k}乙", f"E{k}") for k in range(600)] + [(long, "L"), ("丙", "S"), ("乙丙", "T")], "form string, entity string")
    asked = ask(spark, "见" + long + "乙丙", "名" + "甲" * 450 + "乙", "")
    assert {(r.query, r.entity, r["at"]) for r in R.mentions(asked, forms).collect()} == {("q0", "L", 2), ("q0", "S", 504), ("q0", "T", 503), ("q0", "E0", 502), ("q1", "E450", 1)}


def test_dense_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1)[:, None]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    vectors = spark.createDataFrame([*rows, (99, None)], "item int, vector array<double>")
    queries = spark.createDataFrame(rows[:9], "query int, vector array<double>")
    want = {(q, int(i)) for q in range(9) for i in np.argsort(-np.round(m @ m[q], 6), kind="stable")[:3]}
    for block in (2, 4096):
        assert {(r.query, r["item"]) for r in R.dense(vectors, queries, 3, block).collect()} == want
    assert R.dense(vectors, queries.limit(0), 3).count() == 0
