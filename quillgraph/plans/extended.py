"""Registered queries of resolution, rule facts, graph retrieval, scores and data checks, each beside its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import answering as A
from quillgraph.operators import extraction as X
from quillgraph.operators import facts as K
from quillgraph.operators import graph as G
from quillgraph.operators import resolution as E
from quillgraph.operators import retrieval as R
from quillgraph.operators import routing as W
from quillgraph.plans import catalog as C
from quillgraph.plans import sql as S
from quillgraph.plans import written
from quillgraph.sources import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _empty() -> F.Column:
    return F.array().cast("array<string>")


# facts by rules


@query
def rule_facts(s: SparkSession, d: str) -> DataFrame:
    return K.facts(C.documents(s, d)).select("id", "relation", "subject", "object")


def _rules_sql() -> str:
    me = "title"
    for x in K.SUFFIXES:
        me = f"replace({me}, {S._q(x)}, '')"
    parts = [
        f"SELECT id, {S._q(r)} AS relation, me, unnest(regexp_extract_all(text, {S._q(p)}, 1)) AS s, unnest(regexp_extract_all(text, {S._q(p)}, 2)) AS o FROM page WHERE scope = {S._q(t)}"
        for t, r, p in K.RULES
    ]
    return (
        f"WITH page AS (SELECT id, text, trim({me.replace('title', 'coalesce(title, ' + chr(39) * 2 + ')')}) AS me, CASE WHEN doc_type = 'setting' THEN 'story' ELSE doc_type END AS scope FROM documents WHERE length(text) > 0), "
        f"hit AS ({' UNION ALL '.join(parts)}), fact AS (SELECT DISTINCT id, relation, CASE WHEN s = '' THEN me ELSE trim(s) END AS subject, CASE WHEN o = '' THEN me ELSE trim(o) END AS object FROM hit) "
        "SELECT * FROM fact WHERE subject <> '' AND object <> ''"
    )


SQL["rule_facts"] = _rules_sql()


@query
def listed_facts(s, d):
    return K.listed(C.documents(s, d)).select("id", "relation", "subject", "object").distinct()


@query
def checked_facts(s, d):
    """Facts of rules and lists after the chain of checks, by relation and reason."""
    found = K.facts(C.documents(s, d)).unionByName(K.listed(C.documents(s, d)))
    return K.checked(found, C.documents(s, d)).groupBy("relation", "reason").agg(F.count("*").alias("facts"))


@query
def title_entities(s, d):
    return C.documents(s, d).select("id", K.title_entity(F.col("title")).alias("entity"))


SQL["title_entities"] = "SELECT id, trim(" + "".join("replace(" for _ in K.SUFFIXES) + "coalesce(title, '')" + "".join(f", {S._q(x)}, '')" for x in K.SUFFIXES) + ") AS entity FROM documents"


# resolution


def _names(s, d):
    return X.mentions(table(s, d, "triples")).select("name", "type")


MENTION = """e AS (SELECT triple_id, 0 AS pos, subject AS name, subject_type AS type FROM triples UNION ALL SELECT triple_id, 1, object, object_type FROM triples WHERE object_type <> 'Literal'),
    n AS (SELECT name, last(type ORDER BY triple_id, pos) AS type FROM e WHERE name <> '' GROUP BY name)"""


@query
def declared_aliases(s, d):
    return E.declared(table(s, d, "triples"), _names(s, d))


SQL["declared_aliases"] = f"WITH {MENTION} SELECT DISTINCT subject AS a, object AS b FROM triples WHERE relation = 'ALIAS' AND subject <> object AND subject IN (SELECT name FROM n) AND object IN (SELECT name FROM n)"


@query
def related_pairs(s, d):
    return E.related(table(s, d, "triples"))


SQL["related_pairs"] = "SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM triples WHERE object_type <> 'Literal' AND subject <> object AND least(subject, object) <> ''"


@query
def cosine_pairs(s, d):
    return E.near_names(C.entities(s, d))


_BUCKETS = "list_transform(CASE WHEN length({c}) <= 2 THEN [{c}] ELSE list_transform(range(1, length({c})), lambda i: substring({c}, i, 2)) END, lambda w: CAST(('0x' || substring(md5(w), 1, 8)) AS UBIGINT) % 256)"
_DOT = "CAST(list_sum(list_transform({p}, lambda v: len(list_filter({q}, lambda w: w = v)))) AS DOUBLE)"


def _norm_sql(p: str) -> str:
    return f"(sqrt({_DOT.format(p=p, q=p)}) + CAST(1e-9 AS DOUBLE))"


SQL["cosine_pairs"] = (
    f"WITH p AS ({S.SQL['candidate_pairs'].replace('WITH n AS', 'WITH n AS', 1)}), v AS (SELECT a, b, verdict, {_BUCKETS.format(c='a')} AS x, {_BUCKETS.format(c='b')} AS y FROM p), "
    f"c AS (SELECT a, b, verdict, round({_DOT.format(p='x', q='y')} / ({_norm_sql('x')} * {_norm_sql('y')}), 6) AS similarity FROM v) SELECT * FROM c WHERE similarity >= 0.72"
)


@query
def resolve_entities(s, d):
    """Mentions with their representative: declared aliases, then equal normal forms; weak pairs stay undecided without verdicts."""
    triples = table(s, d, "triples")
    return E.resolved(_names(s, d), E.declared(triples, _names(s, d)))


RESOLVED = f"""{MENTION}, al AS (SELECT DISTINCT subject AS a, object AS b FROM triples WHERE relation = 'ALIAS' AND subject <> object AND subject IN (SELECT name FROM n) AND object IN (SELECT name FROM n)),
    eq AS (SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.type = y.type AND {S._norm('x.name')} = {S._norm('y.name')} AND x.name <> y.name WHERE {S._norm('x.name')} <> ''),
    li AS (SELECT a, b FROM al UNION SELECT b, a FROM al UNION SELECT a, b FROM eq),
    re(v, w) AS (SELECT name, name FROM n UNION SELECT re.v, li.b FROM re JOIN li ON li.a = re.w),
    res AS (SELECT v AS name, first(w ORDER BY length(w) DESC, w) AS representative FROM re GROUP BY v)"""
SQL["resolve_entities"] = f"WITH RECURSIVE {RESOLVED} SELECT name, type, representative FROM res JOIN n USING (name)"


@query
def resolve_judged(s, d):
    """As resolve_entities, with every near weak pair (cosine) taken as judged the same: joined by similarity unless related or incompatible."""
    triples, names = table(s, d, "triples"), _names(s, d)
    pairs = E.near_names(names.withColumnRenamed("type", "entity_type"))
    verdicts = pairs.select("a", "b", F.lit(True).alias("same"), F.lit(1.0).alias("confidence"), "similarity")
    return E.resolved(names, E.declared(triples, names), verdicts, E.related(triples))


def _graph(s, d):
    return E.graph_of(table(s, d, "triples"), resolve_entities(s, d))


@query
def graph_entities(s, d):
    return _graph(s, d)[0].select("id", "name", "type", F.array_join("aliases", "|").alias("aliases"))


@query
def graph_edges(s, d):
    return _graph(s, d)[1].select("src", "rel", "dst", "seq", F.size("docs").cast("long").alias("docs"))


IDS = f"""{RESOLVED}, mn AS (SELECT triple_id, name FROM e WHERE name <> ''), ft AS (SELECT representative, first('E' || triple_id || '/' || name ORDER BY triple_id, name) AS id, last(type ORDER BY triple_id, name) AS type FROM mn JOIN res USING (name) JOIN n USING (name) GROUP BY representative)"""
SQL["graph_entities"] = f"""WITH RECURSIVE {IDS}, fo AS (SELECT representative, name AS form FROM res UNION SELECT representative, object FROM triples JOIN res ON res.name = subject WHERE relation = 'ALIAS' AND object_type = 'Literal' AND object <> ''),
    ag AS (SELECT representative, array_to_string(list(form ORDER BY form), '|') AS aliases FROM fo WHERE form <> representative GROUP BY representative)
    SELECT id, representative AS name, type, coalesce(aliases, '') AS aliases FROM ft LEFT JOIN ag USING (representative)"""
SQL["graph_edges"] = f"""WITH RECURSIVE {IDS}, ids AS (SELECT name, id FROM res JOIN ft USING (representative)),
    ro AS (SELECT a.id AS src, relation AS rel, CASE WHEN object_type = 'Literal' THEN 'lit:' || object ELSE b.id END AS dst, triple_id AS seq, source_doc FROM triples JOIN ids a ON a.name = subject LEFT JOIN ids b ON b.name = object)
    SELECT src, rel, dst, min(seq) AS seq, count(DISTINCT source_doc) AS docs FROM ro WHERE dst IS NOT NULL GROUP BY ALL"""


# graph retrieval


@query
def question_relations(s, d):
    return W.question_relations(C._questions(s, d)).select("query", F.array_join("relations", ",").alias("relations"))


_WORDS = ", ".join(f"({S._q(w)}, [{', '.join(S._q(r) for r in rs)}])" for w, rs in W.RELATION_WORDS.items())
ASKED = f"rw(word, rels) AS (VALUES {_WORDS}), aq AS (SELECT id AS query, unnest(rels) AS rel FROM eval_set JOIN rw ON contains(question, word)), ar AS (SELECT query, array_to_string(list(DISTINCT rel ORDER BY rel), ',') AS relations FROM aq GROUP BY query)"
SQL["question_relations"] = f"WITH {ASKED} SELECT id AS query, coalesce(relations, '') AS relations FROM eval_set LEFT JOIN ar ON ar.query = eval_set.id"


def _asked(s, d):
    return C.searches(s, d).select("query", "text")


@query
def template_choice(s, d):
    asked = _asked(s, d)
    return W.templates(asked, W.seeds_of(asked, C.entities(s, d))).select("query", "seeds", "template")


def _hits(s, d):
    asked, edges = _asked(s, d), written(C.edges(s, d), "edges")
    seeds = written(W.seeds_of(asked, C.entities(s, d)), "seeds")
    return W.graph_documents(edges, seeds, W.templates(asked, seeds)), edges, seeds


@query
def graph_documents(s, d):
    return _hits(s, d)[0].select("query", "template", "doc", "hop")


def _graph_ranked(s, d, k):
    docs, edges, _ = _hits(s, d)
    owned = C.chunks(s, d).select(F.col("id").alias("item"), F.col("doc_id").alias("doc"), F.coalesce("char_offset", F.lit(0)).alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    return W.graph_chunks(docs, edges, C.entities(s, d), owned, k)


@query
def graph_retrieve(s, d):
    return _graph_ranked(s, d, 10)


@query
def graph_trace(s, d):
    docs, _, seeds = _hits(s, d)
    return W.trace(docs, seeds).select("query", "template", F.array_join("linked", "|").alias("linked"), "documents", F.array_join("first", "|").alias("first"))


@query
def relation_path(s, d):
    """The paths between the entities of each search that asks for a link, with their documents."""
    found = G.paths(C.edges(s, d), C.pairs_to_explain(s, d), max_hops=2, limit=12)
    return G.path_documents(found, C.edges(s, d)).select("pair", "place", F.array_join("docs", ",").alias("docs"))


SQL["relation_path"] = f"""WITH p AS ({S._paths(2, 12).replace("SELECT pair, hops, path, row_number()", "SELECT pair, ord, row_number()")}),
    st AS (SELECT pair, place, unnest(list_transform(ord, lambda o: o.seq)) AS seq, generate_subscripts(ord, 1) AS at FROM p),
    ed AS (SELECT subject AS src, relation AS rel, CASE WHEN object_type = 'Literal' THEN 'lit:' || object ELSE object END AS dst, source_doc, min(triple_id) AS pos FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL GROUP BY ALL),
    el AS (SELECT min(pos) AS seq, src, rel, dst FROM ed GROUP BY src, rel, dst), dd AS (SELECT st.pair, st.place, ed.source_doc, min(st.at * 1000000000 + CAST(substring(ed.pos, 2) AS BIGINT)) AS o FROM st JOIN el USING (seq) JOIN ed ON ed.src = el.src AND ed.rel = el.rel AND ed.dst = el.dst WHERE ed.source_doc IS NOT NULL GROUP BY ALL)
    SELECT pair, place, array_to_string(list(source_doc ORDER BY o), ',') AS docs FROM dd GROUP BY pair, place"""


@query
def routed_topk(s, d):
    """Ten chunks for each search: the route decides whether graph or fused lexical retrieval leads, the other fills up."""
    return _routed(s, d, written(_graph_ranked(s, d, 10), "graph"), written(C.rrf_fusion(s, d), "lexical"))


def _routed(s, d, graph, lexical):
    asked = _asked(s, d)
    routes = written(R.routed(asked, R.mentions(asked, R.surface_forms(C.entities(s, d)))), "routes")
    return W.routed_cascade(routes, graph, lexical, 10)


@query
def retriever_comparison(s, d):
    """Mean recall at ten by type of question, one column per retriever."""
    owners = C.chunks(s, d).select(F.col("id").alias("item"), F.col("doc_id").alias("doc"))
    graph, lexical = written(_graph_ranked(s, d, 10), "graph"), written(C.rrf_fusion(s, d), "lexical")
    lists = {"bm25": C.bm25_topk(s, d), "graph": graph, "routed": _routed(s, d, graph, lexical).withColumnRenamed("place", "rank")}
    rows = None
    for name, ranked in lists.items():
        own = A.retrieval_metrics(ranked, owners, C.searches(s, d), (10,)).select("qtype", F.lit(name).alias("retriever"), "recall_10")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("qtype").pivot("retriever", list(lists)).agg(F.round(F.avg("recall_10"), 6))


# scores


@query
def answer_score_full(s, d):
    return A.fully_scored(C.answers(s, d), table(s, d, "eval_set"), C.entities(s, d)).drop("latency_ms", "cost_usd")


FORMS = "fm AS (SELECT DISTINCT name, form FROM (SELECT name, name AS form FROM entity UNION ALL SELECT name, unnest(aliases) FROM entity) WHERE name <> '' AND form <> '')"
FULL = f"""WITH {S.ENTITY}, {S.ANSWER}, {FORMS}, q AS (SELECT id AS question_id, qtype, gold_entities, gold_docs, expect_refusal FROM eval_set),
    ge AS (SELECT question_id, unnest(gold_entities) AS name, generate_subscripts(gold_entities, 1) AS p FROM q),
    gf AS (SELECT question_id, p, {S._squash('coalesce(form, ge.name)')} AS form FROM ge LEFT JOIN fm USING (name)),
    ro AS (SELECT answer.*, q.qtype, q.gold_entities, q.gold_docs, q.expect_refusal, {S._squash(S._uncited("coalesce(text, '')"))} AS squashed, {S.REFUSES} AS says_no FROM answer JOIN q USING (question_id)),
    hi AS (SELECT answer_id, count(DISTINCT p) AS hit FROM ro JOIN gf USING (question_id) WHERE form <> '' AND contains(squashed, form) GROUP BY answer_id),
    sc AS (SELECT ro.*, coalesce(hit, 0) AS hit, coalesce(len(gold_entities), 0) AS n, list_filter(coalesce(citations, []), lambda c: c.valid) AS good FROM ro LEFT JOIN hi USING (answer_id)),
    s2 AS (SELECT *, CASE WHEN expect_refusal THEN CAST(says_no AS INT)::DOUBLE ELSE CAST(n > 0 AND hit = n AS INT)::DOUBLE END AS correct, list_filter(good, lambda c: c.doc_id IS NOT NULL AND c.doc_id <> '') AS src FROM sc),
    full_score AS (SELECT answer_id, question_id, qtype, prompt_id, says_no AS refused, CASE WHEN NOT expect_refusal THEN round(CASE WHEN n > 0 THEN CAST(hit AS DOUBLE) / n ELSE 1 END, 6) END AS entity_recall, correct,
      CASE WHEN expect_refusal THEN CAST(says_no AS INT)::DOUBLE END AS refusal_correct, CASE WHEN NOT expect_refusal THEN CAST(says_no AND correct = 0 AS INT)::DOUBLE END AS false_refusal,
      CASE WHEN len(citations) > 0 THEN round(CAST(len(good) AS DOUBLE) / len(citations), 6) END AS citation_valid,
      CASE WHEN len(src) > 0 AND len(gold_docs) > 0 THEN round(CAST(len(list_filter(src, lambda c: list_contains(gold_docs, c.doc_id))) AS DOUBLE) / len(src), 6) END AS citation_grounded, latency_ms, cost_usd FROM s2)"""
SQL["answer_score_full"] = f"{FULL} SELECT * EXCLUDE (latency_ms, cost_usd) FROM full_score"
MEANS = ("entity_recall", "correct", "refusal_correct", "false_refusal", "citation_valid", "citation_grounded")


@query
def score_by_prompt(s, d):
    """Means of the applicable scores and the cost, by prompt and type, with the total of each prompt."""
    rows = A.fully_scored(C.answers(s, d), table(s, d, "eval_set"), C.entities(s, d))
    folded = rows.rollup("prompt_id", "qtype").agg(F.count("*").alias("answers"), *(A.mean(c).alias(c) for c in MEANS), F.round(F.sum("cost_usd"), 6).alias("cost"))
    return folded.where("prompt_id is not null").withColumn("qtype", F.coalesce("qtype", F.lit("all")))


SQL["score_by_prompt"] = f"{FULL} SELECT prompt_id, coalesce(qtype, 'all') AS qtype, count(*) AS answers, " + ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in MEANS) + ", round(sum(cost_usd), 6) AS cost FROM full_score GROUP BY ROLLUP (prompt_id, qtype) HAVING prompt_id IS NOT NULL"


@query
def entity_mapping(s, d):
    """Nodes of the rule extractor's facts and the record each means, by normal form."""
    nodes = table(s, d, "triples").where("extractor = 'rule' and subject <> ''").select(F.col("subject").alias("id")).distinct()
    gold = C.entities(s, d).select("id", F.concat(F.array(F.coalesce("name", F.lit(""))), F.coalesce("aliases", _empty())).alias("forms"))
    return E.mapped(nodes.select("id", F.array("id").alias("forms")), gold).select(F.col("id").alias("node"), "gold")


MAPPING = f"""{S.ENTITY}, gi AS (SELECT {S._norm('form')} AS norm, min(id) AS gold FROM (SELECT id, name AS form FROM entity UNION ALL SELECT id, unnest(aliases) FROM entity) GROUP BY norm HAVING norm <> ''),
    mp AS (SELECT node, gold FROM (SELECT DISTINCT subject AS node FROM triples WHERE extractor = 'rule' AND subject <> '') LEFT JOIN gi ON gi.norm = {S._norm('node')})"""
SQL["entity_mapping"] = f"WITH {MAPPING} SELECT node, gold FROM mp"


@query
def resolution_debt(s, d):
    """How many nodes a record was split into, for the records with more than one."""
    return entity_mapping(s, d).where("gold is not null").groupBy("gold").agg(F.count("*").alias("nodes")).where("nodes > 1")


SQL["resolution_debt"] = f"WITH {MAPPING} SELECT gold, count(*) AS nodes FROM mp WHERE gold IS NOT NULL GROUP BY gold HAVING count(*) > 1"


@query
def edge_keys_prf(s, d):
    """Facts of one extractor against another's over comparable keys: literals in normal form, symmetric ends in order."""
    dst = F.when(F.col("object_type") == "Literal", F.concat(F.lit("lit:"), "object")).otherwise(F.col("object"))
    keys = table(s, d, "triples").where("subject is not null and object is not null").select("extractor", T.edge_key(F.col("subject"), F.col("relation"), dst).alias("k")).select("extractor", "k.*").distinct()
    side = lambda e, c: keys.where(F.col("extractor") == e).select("src", "rel", "dst", F.lit(1).alias(c))
    both = side("rule", "f").join(side("v4_structural", "g"), ["src", "rel", "dst"], "full").groupBy("rel")
    return both.agg(F.count("f").alias("found"), F.count("g").alias("gold"), F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("right"))


_LIT = f"CASE WHEN object_type = 'Literal' THEN 'lit:' || {S._norm('object')} ELSE object END"
SQL["edge_keys_prf"] = f"""WITH k AS (SELECT DISTINCT extractor, CASE WHEN relation IN ('SPOUSE_OF', 'FRIEND_OF') AND subject > o THEN o ELSE subject END AS src, relation AS rel, CASE WHEN relation IN ('SPOUSE_OF', 'FRIEND_OF') AND subject > o THEN subject ELSE o END AS dst
      FROM (SELECT *, {_LIT} AS o FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL)),
    f AS (SELECT src, rel, dst, 1 AS f FROM k WHERE extractor = 'rule'), g AS (SELECT src, rel, dst, 1 AS g FROM k WHERE extractor = 'v4_structural')
    SELECT rel, count(f) AS found, count(g) AS gold, count(*) FILTER (f IS NOT NULL AND g IS NOT NULL) AS "right" FROM f FULL JOIN g USING (src, rel, dst) GROUP BY rel"""


#: Prices per million tokens of `token_costs`: input, output. A parameter of the query's report, not of the tables.
PRICES = (0.27, 1.10)


@query
def token_costs(s, d):
    """Tokens and their cost by model; cached results are free."""
    rows = table(s, d, "llm_results").dropDuplicates(["result_key", "model", "input_tokens", "output_tokens", "from_cache"])
    cost = T.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(PRICES[0]), F.lit(PRICES[1]), F.col("from_cache"))
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum(cost), 4).alias("cost"))


SQL["token_costs"] = f"""WITH r AS (SELECT DISTINCT result_key, model, input_tokens, output_tokens, from_cache FROM llm_results)
    SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(sum(CASE WHEN coalesce(from_cache, false) THEN 0 ELSE (coalesce(input_tokens, 0) * CAST({PRICES[0]} AS DOUBLE) + coalesce(output_tokens, 0) * CAST({PRICES[1]} AS DOUBLE)) / 1e6 END), 4) AS cost FROM r GROUP BY model"""


@query
def run_summary(s, d):
    """Answers, refusals, latency and cost by prompt and route: the summary of a run."""
    rows = C.answers(s, d)
    return rows.groupBy("prompt_id", F.coalesce("route", F.lit("unknown")).alias("route")).agg(
        F.count("*").alias("answers"), F.count_if(T.refuses(F.col("text"))).alias("refusals"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 4).alias("latency"), F.round(F.sum("cost_usd"), 6).alias("cost")
    )


SQL["run_summary"] = f"WITH {S.ANSWER} SELECT prompt_id, coalesce(route, 'unknown') AS route, count(*) AS answers, count(*) FILTER ({S.REFUSES}) AS refusals, round(coalesce(avg(latency_ms), 0), 4) AS latency, round(sum(cost_usd), 6) AS cost FROM answer GROUP BY ALL"


@query
def runs_compared(s, d):
    """Two runs over their common questions: how often each combination of right and wrong occurs, and the difference in cost."""
    rows = A.fully_scored(C.answers(s, d), table(s, d, "eval_set"), C.entities(s, d)).groupBy("question_id", "qtype", "prompt_id").agg(F.max("correct").alias("correct"), F.avg("cost_usd").alias("cost"))
    side = lambda p, n: rows.where(F.col("prompt_id") == p).select("question_id", "qtype", F.col("correct").alias(f"{n}_correct"), F.col("cost").alias(f"{n}_cost"))
    both = side("answer/v1_naive", "old").join(side("answer/v3_guarded", "new").drop("qtype"), "question_id")
    return both.groupBy("qtype", "old_correct", "new_correct").agg(F.count("*").alias("questions"), F.round(F.sum(F.col("new_cost") - F.col("old_cost")), 4).alias("more_cost"))


SQL["runs_compared"] = f"""{FULL}, p AS (SELECT question_id, qtype, prompt_id, max(correct) AS correct, avg(cost_usd) AS cost FROM full_score GROUP BY ALL)
    SELECT o.qtype, o.correct AS old_correct, n.correct AS new_correct, count(*) AS questions, round(sum(n.cost - o.cost), 4) AS more_cost FROM p o JOIN p n USING (question_id) WHERE o.prompt_id = 'answer/v1_naive' AND n.prompt_id = 'answer/v3_guarded' GROUP BY ALL"""


@query
def mark_calibration(s, d):
    """How far the stored refusal marks agree with the refusal words, by split, and whether that reaches 95 per cent."""
    q = table(s, d, "eval_set").select(F.col("id").alias("question_id"), "split")
    rows = C.answers(s, d).where("refused is not null").join(q, "question_id").withColumn("same", F.col("refused") == T.refuses(F.coalesce("text", F.lit(""))))
    share = F.count_if("same") / F.count("*")
    return rows.groupBy("split").agg(F.count("*").alias("labels"), F.count_if("same").alias("agreed"), F.round(share, 6).alias("share"), (share >= 0.95).alias("passes"))


SQL["mark_calibration"] = f"""WITH {S.ANSWER}, r AS (SELECT split, refused = {S.REFUSES} AS same FROM answer JOIN eval_set q ON q.id = answer.question_id WHERE refused IS NOT NULL)
    SELECT split, count(*) AS labels, count(*) FILTER (same) AS agreed, round(count(*) FILTER (same) / count(*), 6) AS share, count(*) FILTER (same) / count(*) >= 0.95 AS passes FROM r GROUP BY split"""


@query
def cited_documents(s, d):
    """The documents that answers name in their text."""
    return C.answers(s, d).select("answer_id", F.posexplode(T.document_ids(F.coalesce("text", F.lit("")))).alias("place", "doc")).unionByName(
        C.answers(s, d).select("answer_id", F.posexplode(F.array_distinct(F.transform("citations", lambda c: c["doc_id"]))).alias("place", "doc")).where("doc is not null")
    )


SQL["cited_documents"] = f"""WITH {S.ANSWER}, t AS (SELECT answer_id, regexp_extract_all(coalesce(text, ''), 'doc-[0-9]{{4,8}}') AS l FROM answer), u AS (SELECT answer_id, unnest(l) AS doc, generate_subscripts(l, 1) AS p FROM t),
    c AS (SELECT answer_id, list_transform(citations, lambda c: c.doc_id) AS l FROM answer), v AS (SELECT answer_id, unnest(l) AS doc, generate_subscripts(l, 1) AS p FROM c),
    a AS (SELECT answer_id, doc, min(p) AS p FROM u GROUP BY ALL), b AS (SELECT answer_id, doc, min(p) AS p FROM v GROUP BY ALL)
    SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY p) - 1 AS INT) AS place, doc FROM a
    UNION ALL SELECT * FROM (SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY p) - 1 AS INT) AS place, doc FROM b) WHERE doc IS NOT NULL"""


@query
def record_json(s, d):
    """Records as one line of compact JSON each."""
    return C.entities(s, d).select("id", T.compact_json("id", "entity_type", "name").alias("json"))


SQL["record_json"] = f"""WITH {S.ENTITY} SELECT id, '{{"id":' || to_json(id) || ',"entity_type":' || coalesce(to_json(entity_type), 'null') || ',"name":' || coalesce(to_json(name), 'null') || '}}' AS json FROM entity"""


# data checks


@query
def dq_evidence(s, d):
    """Questions against their documents: a trap has none, others have some and all exist."""
    q = table(s, d, "eval_set").select("id", "expect_refusal", "gold_docs")
    lost = q.select("id", F.explode("gold_docs").alias("doc")).join(C.documents(s, d).select(F.col("id").alias("doc")), "doc", "left_anti").select("id").distinct().withColumn("lost", F.lit(True))
    n = F.coalesce(F.size("gold_docs"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    state = F.when(F.col("expect_refusal") & (n > 0), "trap with documents").when(~F.col("expect_refusal") & (n == 0), "no document").when(F.col("lost"), "unknown document").otherwise("complete")
    return q.join(lost, "id", "left").groupBy(state.alias("state"), "expect_refusal").agg(F.count("*").alias("questions"))


SQL["dq_evidence"] = """WITH l AS (SELECT DISTINCT id FROM (SELECT id, unnest(gold_docs) AS doc FROM eval_set) WHERE doc NOT IN (SELECT id FROM documents)),
    q AS (SELECT expect_refusal, coalesce(len(gold_docs), 0) AS n, id IN (SELECT id FROM l) AS lost FROM eval_set)
    SELECT CASE WHEN expect_refusal AND n > 0 THEN 'trap with documents' WHEN NOT expect_refusal AND n = 0 THEN 'no document' WHEN lost THEN 'unknown document' ELSE 'complete' END AS state, expect_refusal, count(*) AS questions FROM q GROUP BY ALL"""


@query
def dq_gold_support(s, d):
    """How each gold entity stands in the gold documents: by name, by an alias only, or not at all; numbers are left out."""
    q = table(s, d, "eval_set").where("not derived and not expect_refusal")
    pairs = q.select("id", F.explode("gold_entities").alias("name"), "gold_docs").where(~F.col("name").rlike("^[0-9]+$")).select("id", "name", F.explode("gold_docs").alias("doc")).distinct()
    rows = pairs.join(C.documents(s, d).select(F.col("id").alias("doc"), F.coalesce("text", F.lit("")).alias("text")), "doc").join(A.alias_forms(C.entities(s, d)), "name", "left")
    seen = rows.groupBy("id", "name").agg(F.max(F.contains("text", "name")).alias("plain"), F.max(F.exists(F.coalesce("forms", _empty()), lambda f: F.contains(F.col("text"), f))).alias("other"))
    return seen.select("id", "name", F.when(F.col("plain"), "name").when(F.col("other"), "alias").otherwise("absent").alias("support"))


SQL["dq_gold_support"] = f"""WITH {S.ENTITY}, {FORMS}, p AS (SELECT DISTINCT id, name, unnest(gold_docs) AS doc FROM (SELECT id, unnest(gold_entities) AS name, gold_docs FROM eval_set WHERE NOT derived AND NOT expect_refusal) WHERE NOT regexp_matches(name, '^[0-9]+$')),
    r AS (SELECT p.id, p.name, contains(coalesce(d.text, ''), p.name) AS plain, coalesce(contains(coalesce(d.text, ''), form), false) AS other FROM p JOIN documents d ON d.id = p.doc LEFT JOIN fm ON fm.name = p.name)
    SELECT id, name, CASE WHEN bool_or(plain) THEN 'name' WHEN bool_or(other) THEN 'alias' ELSE 'absent' END AS support FROM r GROUP BY ALL"""


@query
def dq_shortcuts(s, d):
    """Questions of several steps whose two ends, the first linked entity and the first gold entity, stand in one document."""
    q = table(s, d, "eval_set").where("hops >= 2 and not expect_refusal and size(gold_entities) > 0")
    asked = q.select(F.col("id").alias("query"), F.col("question").alias("text"))
    first = W.seeds_of(asked, C.entities(s, d)).groupBy("query").agg(F.min_by("node", "place").alias("source"))
    ends = q.select(F.col("id").alias("query"), "qtype", F.element_at("gold_entities", 1).alias("target")).join(first, "query").where("source <> target")
    names = ends.select(F.explode(F.array("source", "target")).alias("form")).distinct().where("form <> ''").withColumn("entity", F.col("form"))
    texts = C.documents(s, d).where(F.length("text") > 0).select(F.col("id").alias("query"), "text")
    held = R.mentions(texts, names).select(F.col("query").alias("doc"), "form")
    met = ends.join(held.withColumnRenamed("form", "source"), "source").join(held.withColumnRenamed("form", "target"), ["doc", "target"])
    return met.groupBy("query", "qtype").agg(F.countDistinct("doc").alias("documents"))


@query
def dq_question_overlap(s, d):
    """Four-character windows of the questions of one type that stand in any document: questions with and without."""
    q = table(s, d, "eval_set").where("qtype = 'semantic_only' or expect_refusal").select("id", "qtype", F.explode_outer(T.four_grams(F.col("question"))).alias("gram"))
    wanted = q.select("gram").where("gram is not null").distinct()
    texts = C.documents(s, d).where(F.length("text") > 3).select(F.col("id").alias("query"), "text")
    seen = R.mentioned(texts, wanted.select(F.col("gram").alias("form"))).select(F.col("form").alias("gram"), F.lit(1).alias("seen"))
    per = q.join(seen, "gram", "left").groupBy("id", "qtype").agg(F.count("seen").alias("shared"))
    return per.groupBy("qtype").agg(F.count("*").alias("questions"), F.count_if(F.col("shared") > 0).alias("overlapping"), F.sum("shared").alias("windows"))


SQL["dq_question_overlap"] = """WITH t AS (SELECT id, qtype, regexp_replace(regexp_replace(question, '^(哪只狼|哪只羊|哪个机器人|哪位角色|谁)', ''), '？$', '') AS t FROM eval_set WHERE qtype = 'semantic_only' OR expect_refusal),
    g AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4))) AS gram FROM t WHERE length(t) >= 4),
    w AS (SELECT DISTINCT unnest(list_transform(range(1, length(text) - 2), lambda i: substring(text, i, 4))) AS gram FROM documents WHERE length(text) > 3),
    p AS (SELECT t.id, any_value(t.qtype) AS qtype, count(w.gram) AS shared FROM t LEFT JOIN g ON g.id = t.id LEFT JOIN w ON w.gram = g.gram GROUP BY t.id)
    SELECT qtype, count(*) AS questions, count(*) FILTER (shared > 0) AS overlapping, CAST(sum(shared) AS BIGINT) AS windows FROM p GROUP BY qtype"""


@query
def dq_replay(s, d):
    """Answers whose model result is stored and those that can't be replayed, by prompt."""
    known = table(s, d, "llm_results").select("result_key").distinct().withColumn("hit", F.lit(1))
    return C.answers(s, d).join(known, "result_key", "left").groupBy("prompt_id").agg(F.count("*").alias("answers"), F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("missing"))


SQL["dq_replay"] = f"WITH {S.ANSWER}, k AS (SELECT DISTINCT result_key FROM llm_results WHERE result_key IS NOT NULL) SELECT prompt_id, count(*) AS answers, count(k.result_key) AS hits, count(*) - count(k.result_key) AS missing FROM answer LEFT JOIN k USING (result_key) GROUP BY prompt_id"


@query
def gold_documents(s, d):
    """The documents that a question's evidence needs: sources of all facts about its gold entities, sorted, with its own."""
    facts = table(s, d, "triples").where("source_doc is not null").select(F.col("subject").alias("entity"), F.col("source_doc").alias("doc")).distinct()
    q = table(s, d, "eval_set").where("not expect_refusal")
    own = q.select("id", F.explode("gold_docs").alias("doc"))
    more = q.select("id", F.explode("gold_entities").alias("entity")).join(facts, "entity").select("id", "doc")
    return own.unionByName(more).distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("doc")), ",").alias("docs"))


SQL["gold_documents"] = """WITH q AS (SELECT * FROM eval_set WHERE NOT expect_refusal), u AS (SELECT id, unnest(gold_docs) AS doc FROM q
    UNION SELECT id, source_doc FROM (SELECT id, unnest(gold_entities) AS entity FROM q) g JOIN triples t ON t.subject = g.entity WHERE source_doc IS NOT NULL)
    SELECT id, array_to_string(list(doc ORDER BY doc), ',') AS docs FROM u WHERE doc IS NOT NULL GROUP BY id"""


# filters and catalogs


@query
def entities_by_type(s, d):
    """Records by type, the unknown one apart, with their names and aliases counted."""
    return C.entities(s, d).groupBy(F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).agg(F.count("*").alias("records"), F.countDistinct("name").alias("names"), F.sum(F.greatest(F.coalesce(F.size("aliases"), F.lit(0)), F.lit(0))).alias("aliases"))


SQL["entities_by_type"] = f"WITH {S.ENTITY} SELECT coalesce(entity_type, 'unknown') AS entity_type, count(*) AS records, count(DISTINCT name) AS names, CAST(sum(coalesce(len(aliases), 0)) AS BIGINT) AS aliases FROM entity GROUP BY ALL"


@query
def question_catalog(s, d):
    """Answerable questions of the development split that have gold documents, in order of type and text."""
    q = table(s, d, "eval_set").where("split = 'dev' and size(gold_docs) > 0 and not expect_refusal")
    place = F.row_number().over(Window.partitionBy("qtype").orderBy("question", "id"))
    return q.select("id", "qtype", place.alias("place"))


SQL["question_catalog"] = "SELECT id, qtype, row_number() OVER (PARTITION BY qtype ORDER BY question, id) AS place FROM eval_set WHERE split = 'dev' AND len(gold_docs) > 0 AND NOT expect_refusal"


@query
def answers_or_refusals(s, d):
    """The extractive answer of each search; where nothing was found, the fixed refusal."""
    ranked = R.bm25(C.chunk_texts(s, d), _asked(s, d), 1)
    return A.extractive_or_refusal(_asked(s, d), ranked, C.chunks(s, d).select(F.col("id").alias("item"), "raw_text"))


SQL["answers_or_refusals"] = f"WITH {S.CHUNKS}, {S.SEARCH}, {S._bm25('best', S.TEXTS, 1)}, a AS (SELECT query, substring(replace(coalesce(raw_text, ''), '\n', ' '), 1, 300) || '[1]' AS answer FROM best JOIN chunk ON chunk.id = best.item) SELECT search.query, coalesce(answer, '资料中未提及。') AS answer, answer IS NULL AS refused FROM search LEFT JOIN a USING (query)"
