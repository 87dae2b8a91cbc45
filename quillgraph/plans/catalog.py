"""The registered queries of the core operators over the project's tables.

Searches take as queries every row whose id is divisible by 50 and run against all rows; all else covers whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import answering as A
from quillgraph.operators import chunking as C
from quillgraph.operators import extraction as X
from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R
from quillgraph.sources import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").dropDuplicates(["id"])


def entities(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "entities").dropDuplicates(["id"])


def answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "answers").dropDuplicates(["answer_id"])


def searches(s: SparkSession, d: str) -> DataFrame:
    """query, text, docs of the questions whose number is divisible by 50."""
    q = table(s, d, "eval_set").where("cast(substring(id, 3) AS int) % 50 = 0")
    return q.select(F.col("id").alias("query"), F.col("question").alias("text"), "qtype", F.col("gold_docs").alias("docs"))


def chunk_texts(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).select(F.col("id").alias("item"), F.coalesce("text", F.lit("")).alias("text"))


def heading_texts(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).select(F.col("id").alias("item"), F.concat_ws(" ", "doc_title", "section").alias("text"))


def edges(s: SparkSession, d: str) -> DataFrame:
    return G.edges_of(table(s, d, "triples"))


def pairs_to_explain(s: SparkSession, d: str) -> DataFrame:
    """Ends of the relations between characters whose triple number is divisible by 50."""
    t = table(s, d, "triples").where("object_type = 'Character' and cast(substring(triple_id, 2) AS int) % 50 = 0")
    return t.select(F.col("triple_id").alias("pair"), F.col("subject").alias("source"), F.col("object").alias("target")).where("source is not null and target is not null")


def seeds(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "triples").where("subject is not null and cast(substring(triple_id, 2) AS int) % 50 = 0")
    return t.select(F.col("triple_id").alias("query"), F.col("subject").alias("node"))


# names, hashes, small functions


@query
def tokenize_terms(s, d):
    return R.index_stats(chunk_texts(s, d))


@query
def normalize_names(s, d):
    return entities(s, d).select("id", T.normal_name(F.col("name")).alias("norm"), T.script(F.coalesce("name", F.lit(""))).alias("script"), T.discriminator(F.coalesce("name", F.lit(""))).alias("mark"))


@query
def lexical_verdict(s, d):
    rows = entities(s, d).where("name is not null").select("id", "name", F.explode("aliases").alias("alias")).where("alias is not null").distinct()
    return rows.select("id", "alias", T.lexical_verdict(F.col("name"), F.col("alias")).alias("verdict"))


@query
def split_assign(s, d):
    return table(s, d, "eval_set").select("id", T.assigned_split(F.col("question")).alias("assigned"))


@query
def hash_embedding(s, d):
    names = entities(s, d).where("name is not null").select("id", F.explode(T.windows(F.col("name"), 2)).alias("w"))
    counts = names.select("id", T.hash_bucket(F.col("w"), 256).alias("bucket")).groupBy("id", "bucket").agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id"))) + F.lit(1e-9)
    return counts.select("id", "bucket", F.round(F.col("n") / norm, 6).alias("weight"))


@query
def keyword_occurrences(s, d):
    rows = table(s, d, "eval_set").select("id", "question", F.explode("trap_keywords").alias("keyword")).distinct()
    return rows.select("id", "keyword", T.occurrences(F.col("question"), F.col("keyword")).alias("n"))


@query
def refusal_markers(s, d):
    return answers(s, d).select("answer_id", T.refuses(F.col("text")).alias("refuses"), F.length(T.without_space(T.without_citations(F.coalesce("text", F.lit(""))))).alias("length"))


# chunks


@query
def chunk_fixed(s, d):
    return C.chunked(documents(s, d).select("doc_id", "title", "text"), "fixed").select("chunk_id", "char_offset", "raw_text")


@query
def chunk_section(s, d):
    return C.chunked(documents(s, d).select("doc_id", "title", "text"), "section").select("chunk_id", "section", "char_offset", "raw_text")


@query
def chunk_contextual(s, d):
    return C.chunked(documents(s, d).select("doc_id", "title", "text"), "contextual").select("chunk_id", "section", "char_offset", "text")


# extraction and resolution


@query
def pattern_extract(s, d):
    return X.extracted(documents(s, d))


@query
def schema_validate(s, d):
    return X.tagged(table(s, d, "triples")).groupBy("reason", "relation").agg(F.count("*").alias("n"))


@query
def triple_dedupe(s, d):
    return X.first_facts(table(s, d, "triples")).select("triple_id", "source_doc", "subject", "relation", "object")


@query
def evidence_check(s, d):
    return X.evidenced(table(s, d, "triples"), documents(s, d))


@query
def evidence_overlap(s, d):
    return X.nearly_evidenced(table(s, d, "triples"), documents(s, d))


@query
def mention_collect(s, d):
    return X.mentions(table(s, d, "triples"))


@query
def candidate_pairs(s, d):
    return X.name_pairs(entities(s, d))


@query
def same_names(s, d):
    return X.same_names(entities(s, d))


# graph


@query
def edge_merge_sources(s, d):
    return edges(s, d).select("src", "rel", "dst", "source_doc", F.array_join("extra_docs", ",").alias("extra"))


@query
def graph_degrees(s, d):
    return G.degrees(edges(s, d))


@query
def graph_stats(s, d):
    e = edges(s, d)
    return e.groupBy("rel").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query
def neighbors_1hop(s, d):
    return G.neighbours(edges(s, d), seeds(s, d).select("node"))


@query
def find_paths(s, d):
    return G.find_paths(edges(s, d), pairs_to_explain(s, d), max_hops=3, limit=5)


@query
def find_paths_deep(s, d):
    """As find_paths, to the depth and limit of the relation template: four hops, twelve paths."""
    return G.find_paths(edges(s, d), pairs_to_explain(s, d), max_hops=4, limit=12)


@query
def relation_chain(s, d):
    chain = ["PARENT_OF", "COUSIN_OF", "UNCLE_OF", "PARTNER_OF", "FRIEND_OF", "LIKES", "SEALED_BY", "MEMBER_OF", "LEADER_OF"]
    return G.walk(edges(s, d), seeds(s, d), 3, chain)


@query
def neighborhood(s, d):
    return G.walk(edges(s, d), seeds(s, d), 2)


@query
def neighborhood_deep(s, d):
    """As neighborhood, to the depth of the neighbourhood template: four hops."""
    return G.walk(edges(s, d), seeds(s, d), 4)


@query
def list_by_relation(s, d):
    rows = table(s, d, "triples").where("relation in ('LEADER_OF', 'MEMBER_OF') and object is not null").select("relation", T.normal_name(F.col("object")).alias("target"), "subject").distinct()
    return rows.groupBy("relation", "target").agg(F.count("*").alias("subjects"))


# retrieval


@query
def bm25_topk(s, d):
    return R.bm25(chunk_texts(s, d), searches(s, d), 10)


def _lists(s, d, k):
    asked = searches(s, d)
    return R.bm25(chunk_texts(s, d), asked, k), R.bm25(heading_texts(s, d), asked, k)


@query
def dense_topk(s, d):
    e = table(s, d, "embeddings")
    vectors = e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    return R.dense(vectors, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 10)


@query
def rrf_fusion(s, d):
    text, heading = _lists(s, d, 30)
    return R.fuse([("text", 1.0, text), ("heading", 1.0, heading)], 10)


@query
def cascade_merge(s, d):
    text, heading = _lists(s, d, 10)
    return R.cascade(heading, text, 10)


@query
def round_robin_emit(s, d):
    hits = searches(s, d).select("query", F.posexplode("docs").alias("hop", "doc")).select("query", "doc", (F.col("hop") + 1).alias("hop"))
    owned = chunks(s, d).select(F.col("doc_id").alias("doc"), F.col("id").alias("item"), F.coalesce("char_offset", F.lit(0)).alias("seq"))
    return R.round_robin(hits, owned, 10)


def _questions(s, d):
    return table(s, d, "eval_set").select(F.col("id").alias("query"), F.col("question").alias("text"))


@query
def entity_mentions(s, d):
    return R.mentions(_questions(s, d), R.surface_forms(entities(s, d)))


@query
def entity_link(s, d):
    return R.linked(_questions(s, d), R.surface_forms(entities(s, d)))


@query
def route_question(s, d):
    found = R.mentions(_questions(s, d), R.surface_forms(entities(s, d)))
    return R.routed(_questions(s, d), found)


# answers


@query
def context_pack(s, d):
    used = answers(s, d).select(F.col("answer_id").alias("query"), F.posexplode("context_chunks").alias("p", "id"))
    rows = used.join(chunks(s, d).select("id", F.col("doc_title").alias("title"), "raw_text"), "id").select("query", (F.row_number().over(Window.partitionBy("query").orderBy("p"))).alias("place"), "title", "raw_text")
    return A.packed_context(rows)


@query
def citation_validate(s, d):
    return A.citations(answers(s, d))


@query
def extractive_answer(s, d):
    return A.extractive(R.bm25(chunk_texts(s, d), searches(s, d), 1), chunks(s, d).select(F.col("id").alias("item"), "raw_text"))


@query
def cache_lookup(s, d):
    rows = A.cached(answers(s, d), table(s, d, "llm_results"))
    return rows.groupBy("model").agg(F.count("*").alias("answers"), F.count_if("hit").alias("hits"), F.count_if("alias_hit").alias("alias_hits"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query
def retrieval_metrics(s, d):
    owners = chunks(s, d).select(F.col("id").alias("item"), F.col("doc_id").alias("doc"))
    return A.retrieval_metrics(R.bm25(chunk_texts(s, d), searches(s, d), 20), owners, searches(s, d))


@query
def metrics_rollup(s, d):
    rows = retrieval_metrics(s, d).rollup("qtype").agg(F.count("*").alias("questions"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "rr")))
    return rows.withColumn("qtype", F.coalesce("qtype", F.lit("all")))


@query
def answer_score(s, d):
    return A.scored(answers(s, d), table(s, d, "eval_set"))


@query
def answer_score_by_type(s, d):
    return answer_score(s, d).groupBy("qtype").agg(F.count("*").alias("answers"), *(A.mean(c).alias(c) for c in ("entity_recall", "correct", "refusal_correct", "false_refusal")))


@query
def prompt_pivot(s, d):
    rows = answer_score(s, d).groupBy("qtype").pivot("prompt_id", ["answer/v1_naive", "answer/v2_cited", "answer/v3_guarded"]).agg(A.mean("correct"))
    return rows.select("qtype", *(F.col(f"`{p}`").alias(p.split("/")[1]) for p in ("answer/v1_naive", "answer/v2_cited", "answer/v3_guarded")))


@query
def ab_flips(s, d):
    rows = answer_score(s, d).join(answers(s, d).select("answer_id", "question_id"), "answer_id")
    per = rows.where("correct is not null").groupBy("question_id", "prompt_id").agg(F.max("correct").alias("correct"))
    side = lambda p, n: per.where(F.col("prompt_id") == p).select("question_id", F.col("correct").alias(n))
    both = side("answer/v1_naive", "old").join(side("answer/v3_guarded", "new"), "question_id")
    return both.where("old <> new").select("question_id", F.when(F.col("new") > F.col("old"), "fixed").otherwise("broken").alias("flip"))


@query
def refusal_confusion(s, d):
    q = table(s, d, "eval_set").select(F.col("id").alias("question_id"), "expect_refusal")
    rows = answers(s, d).join(q, "question_id").select("expect_refusal", "refused", T.refuses(F.col("text")).alias("says_no"))
    return rows.groupBy("expect_refusal", "refused", "says_no").agg(F.count("*").alias("n"))


@query
def extraction_prf(s, d):
    """Facts of one extractor against those of another, per relation."""
    facts = table(s, d, "triples").select("extractor", "relation", "subject", "object").distinct()
    found, gold = facts.where("extractor = 'rule'").drop("extractor").withColumn("f", F.lit(1)), facts.where("extractor = 'v4_structural'").drop("extractor").withColumn("g", F.lit(1))
    rows = found.join(gold, ["relation", "subject", "object"], "full").groupBy("relation")
    rows = rows.agg(F.count("f").alias("found"), F.count("g").alias("gold"), F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("right"))
    p, r = F.col("right") / F.when(F.col("found") > 0, F.col("found")), F.col("right") / F.when(F.col("gold") > 0, F.col("gold"))
    return rows.select("relation", "found", "gold", "right", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("recall"), F.round(2.0 * F.col("right") / (F.col("found") + F.col("gold")), 6).alias("f1"))


# checks of the data


@query
def dq_missing_gold(s, d):
    """By type: questions with an answer, those without a document, the documents they name and how many of these exist."""
    q = table(s, d, "eval_set").where("not expect_refusal").select("id", "qtype", F.explode_outer("gold_docs").alias("doc"))
    rows = q.join(documents(s, d).select(F.col("id").alias("doc"), F.lit(1).alias("known")), "doc", "left")
    return rows.groupBy("qtype").agg(F.countDistinct("id").alias("questions"), F.count_if(F.col("doc").isNull()).alias("without"), F.count("doc").alias("named"), F.count("known").alias("existing"))


@query
def dq_gold_entity_absent(s, d):
    q = table(s, d, "eval_set").where("not derived and not expect_refusal")
    pairs = q.select("id", F.explode("gold_entities").alias("entity"), "gold_docs").select("id", "entity", F.explode("gold_docs").alias("doc"))
    seen = pairs.join(documents(s, d).select(F.col("id").alias("doc"), "text"), "doc").groupBy("id", "entity").agg(F.max(F.contains(F.coalesce("text", F.lit("")), F.col("entity"))).alias("seen"))
    return seen.where("not seen").select("id", "entity")


@query
def dq_split_leak(s, d):
    return table(s, d, "eval_set").where("question is not null").groupBy("question").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("rows")).where("splits > 1")


@query
def dataset_summary(s, d):
    rows = table(s, d, "eval_set").cube("qtype", "split").agg(F.grouping_id("qtype", "split").alias("g"), F.count("*").alias("questions"), F.count_if("expect_refusal").alias("traps"))
    return rows.where("g < 3").select(F.coalesce("qtype", F.lit("all")).alias("qtype"), F.coalesce("split", F.lit("all")).alias("split"), "questions", "traps", F.col("g").cast("int").alias("level"))


@query
def read_document(s, d):
    t = F.coalesce("text", F.lit(""))
    return documents(s, d).select("id", F.substring(t, 1, 1500).alias("body"), (F.length(t) > 1500).alias("truncated"))


#: Words of the search `find_entity`.
STEMS = ("合唱团", "学堂", "岛", "choir", "island")


@query
def find_entity(s, d):
    """Records whose name or alias contains a group or place word: substring search over all records."""
    stems = s.createDataFrame([(w,) for w in STEMS], "stem string")
    forms = entities(s, d).select("id", F.explode(F.array_union(F.array(F.coalesce("name", F.lit(""))), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    return forms.join(F.broadcast(stems), F.contains(F.lower("form"), F.lower("stem"))).groupBy("stem").agg(F.countDistinct("id").alias("records"))
