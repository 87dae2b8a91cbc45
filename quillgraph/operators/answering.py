"""Contexts, citations, the extractive answer, the cache of model results, scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T

BUDGET = 9000


def packed_context(used: DataFrame, budget: int = BUDGET) -> DataFrame:
    """used(query, place, title, raw_text) -> query, blocks, characters: blocks in order until the next would pass the budget.

    The first block always stays; separators don't count.
    """
    block = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]（来源："), F.coalesce("title", F.lit("")), F.lit("）\n"), F.coalesce("raw_text", F.lit("")))
    rows = used.select("query", "place", F.length(block).alias("n"))
    running = F.sum("n").over(Window.partitionBy("query").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).where((F.col("running") <= budget) | (F.col("place") == 1)).groupBy("query").agg(F.count("*").alias("blocks"), F.max("running").alias("characters"))


def citations(answers: DataFrame) -> DataFrame:
    """answers(answer_id, text, context_chunks) -> answer_id, idx, chunk_id, valid: distinct [n] in order of the text."""
    marks = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda x: x.cast("int")))
    rows = answers.select("answer_id", "context_chunks", F.explode(marks).alias("idx"))
    chunk = F.when(F.col("idx") >= 1, F.get("context_chunks", F.col("idx") - 1))
    return rows.select("answer_id", "idx", chunk.alias("chunk_id"), chunk.isNotNull().alias("valid"))


def extractive(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked(query, item, rank), chunks(item, raw_text) -> query, answer: the best chunk in one line of 300 characters.

    Questions for which nothing was found have no row; `extractive_or_refusal` gives them one.
    """
    best = ranked.where("rank = 1").join(chunks, "item")
    line = F.substring(F.translate(F.coalesce("raw_text", F.lit("")), "\n", " "), 1, 300)
    return best.select("query", F.concat(line, F.lit("[1]")).alias("answer"))


#: A fixed value: the answer where nothing was retrieved.
NOTHING = "资料中未提及。"


def extractive_or_refusal(questions: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions(query) -> query, answer, refused: as `extractive`, declining where nothing was retrieved."""
    rows = questions.select("query").join(extractive(ranked, chunks), "query", "left")
    return rows.select("query", F.coalesce("answer", F.lit(NOTHING)).alias("answer"), F.col("answer").isNull().alias("refused"))


def with_paths(contexts: DataFrame, paths: DataFrame, most: int = 6) -> DataFrame:
    """contexts(query, context), paths(query, path, place) -> query, context with its first relation paths behind it."""
    lines = paths.where(F.col("place") <= most).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda s: F.concat(F.lit("- "), s["path"])).alias("lines"))
    rows = contexts.join(lines, "query", "left")
    return rows.select("query", F.when(F.size("lines") > 0, F.concat("context", F.lit("\n\n"), F.array_join("lines", "\n"))).otherwise(F.col("context")).alias("context"))


def cached(answers: DataFrame, results: DataFrame) -> DataFrame:
    """answers(answer_id, result_key) with the result of each key: hit, tokens, finish_reason. A key's rows count once."""
    once = results.groupBy("result_key").agg(F.max("model").alias("model"), F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"), F.max("alias_hit").alias("alias_hit"))
    rows = answers.select("answer_id", "result_key").dropDuplicates(["answer_id"]).join(once, "result_key", "left")
    return rows.select("answer_id", F.col("model").isNotNull().alias("hit"), "model", "input_tokens", "output_tokens", F.coalesce("alias_hit", F.lit(False)).alias("alias_hit"))


def alias_forms(entities: DataFrame) -> DataFrame:
    """entities(id, name, aliases) -> name, forms: the name and all aliases of the records with it, sorted."""
    rows = entities.where("name <> ''").select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    return rows.where("form <> ''").groupBy("name").agg(F.array_sort(F.collect_set("form")).alias("forms"))


def fully_scored(answers: DataFrame, questions: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per answer: refused, entity_recall, correct, refusal_correct, false_refusal, citation_valid, citation_grounded.

    A gold entity is there if any of its forms is; a question that expects a refusal is answered rightly by one; grounded is
    the share of the valid citations whose document is a gold document. What doesn't apply is null.
    """
    asked = questions.select(F.col("id").alias("question_id"), "qtype", "gold_entities", "gold_docs", "expect_refusal").dropDuplicates(["question_id"])
    gold = asked.select("question_id", F.explode("gold_entities").alias("name")).distinct().join(alias_forms(entities), "name", "left")
    forms = gold.groupBy("question_id").agg(F.collect_list(F.struct("name", F.transform(F.coalesce("forms", F.array("name")), T.without_space).alias("forms"))).alias("known"))
    text = T.without_space(T.without_citations(F.coalesce(F.col("text"), F.lit(""))))
    rows = answers.dropDuplicates(["answer_id"]).join(asked, "question_id").join(forms, "question_id", "left").withColumn("squashed", text)
    rows = rows.withColumn("known", F.map_from_entries(F.transform(F.coalesce("known", F.array().cast("array<struct<name:string,forms:array<string>>>")), lambda k: F.struct(k["name"], k["forms"]))))
    here = F.filter("gold_entities", lambda g: F.exists(F.coalesce(F.element_at(F.col("known"), g), F.array().cast("array<string>")), lambda f: (f != "") & F.contains(F.col("squashed"), f)))
    n, hit = F.coalesce(F.size("gold_entities"), F.lit(0)), F.size(here).cast("double")
    no, trap = T.refuses(F.col("text")), F.col("expect_refusal")
    right = F.when(trap, no.cast("double")).otherwise(((n > 0) & (hit == n)).cast("double"))
    cited = F.coalesce("citations", F.array().cast(dict(answers.dtypes)["citations"]))
    valid = F.filter(cited, lambda c: c["valid"])
    sourced = F.filter(valid, lambda c: c["doc_id"].isNotNull() & (c["doc_id"] != ""))
    grounded = F.size(F.filter(sourced, lambda c: F.array_contains("gold_docs", c["doc_id"])))
    return rows.select(
        "answer_id", "question_id", "qtype", "prompt_id", no.alias("refused"), F.round(F.when(~trap, F.when(n > 0, hit / n).otherwise(1.0)), 6).alias("entity_recall"), right.alias("correct"),
        F.when(trap, no.cast("double")).alias("refusal_correct"), F.when(~trap, (no & (right == 0.0)).cast("double")).alias("false_refusal"),
        F.round(F.when(F.size(cited) > 0, F.size(valid) / F.size(cited)), 6).alias("citation_valid"),
        F.round(F.when((F.size(sourced) > 0) & (F.size("gold_docs") > 0), grounded / F.size(sourced)), 6).alias("citation_grounded"), "latency_ms", "cost_usd",
    )


def scored(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per answer: refused, entity_recall, correct, refusal_correct, false_refusal, by names alone; not applicable is null."""
    text = T.without_space(T.without_citations(F.coalesce(F.col("text"), F.lit(""))))
    rows = answers.dropDuplicates(["answer_id"]).join(questions.select(F.col("id").alias("question_id"), "qtype", "gold_entities", "expect_refusal").dropDuplicates(["question_id"]), "question_id")
    rows = rows.withColumn("squashed", text).withColumn("says_no", T.refuses(F.col("text")))
    gold = F.transform("gold_entities", T.without_space)
    hit = F.size(F.filter(gold, lambda g: F.contains(F.col("squashed"), g))).cast("double")
    recall = F.when(F.size("gold_entities") > 0, hit / F.size("gold_entities")).otherwise(1.0)
    trap = F.col("expect_refusal")
    rows = rows.withColumn("recall", F.when(~trap, recall)).withColumn("right", F.when(~trap, ((F.size("gold_entities") > 0) & (recall == 1.0)).cast("double")))
    return rows.select(
        "answer_id", "qtype", "prompt_id", F.col("says_no").alias("refused"), F.round("recall", 6).alias("entity_recall"), F.when(trap, F.col("says_no").cast("double")).otherwise(F.col("right")).alias("correct"),
        F.when(trap, F.col("says_no").cast("double")).alias("refusal_correct"), F.when(~trap, (F.col("says_no") & (F.col("right") == 0.0)).cast("double")).alias("false_refusal"),
    )


def mean(c: str) -> Column:
    """Mean over the applicable rows; 0 if there are none."""
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)


def retrieval_metrics(ranked: DataFrame, owners: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """ranked(query, item, rank), owners(item, doc), gold(query, qtype, docs) -> query, qtype, recall@k, hit@k, rr.

    A document's rank is the rank of its first chunk.
    """
    docs = ranked.join(owners, "item").groupBy("query", "doc").agg(F.min("rank").alias("rank"))
    wanted = gold.where(F.size("docs") > 0).select("query", "qtype", F.size("docs").alias("n"), F.explode("docs").alias("doc"))
    rows = wanted.join(docs, ["query", "doc"], "left").groupBy("query", "qtype", "n")
    recalls = [F.round(F.count_if(F.col("rank") <= k) / F.col("n"), 6).alias(f"recall_{k}") for k in ks]
    hits = [F.max(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hit_{k}") for k in ks]
    return rows.agg(*recalls, *hits, F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("rr")).drop("n")
