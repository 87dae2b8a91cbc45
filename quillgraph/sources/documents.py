"""Readers and writers of the project's files: JSON lines, the graph document, prompt files."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans import cut

DOCUMENT = "id string, doc_type string, title string, date string, text string"
GRAPH = (
    "seed int, source string, extractor string, doc_keys map<string,string>, "
    "entities array<struct<id:string,type:string,name:string,aliases:array<string>,props:map<string,string>>>, "
    "edges array<struct<src:string,rel:string,dst:string,source_doc:string,confidence:double,extra_docs:array<string>>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json(F.trim("value"), schema).alias("row")).select("row.*")


def write_jsonl(df: DataFrame, path: str) -> int:
    """One JSON object per line, UTF-8, null fields kept; the number of rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).select(F.to_json(F.struct(*(F.col(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    return seen.get["rows"]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """file, text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def write_text(df: DataFrame, path: str) -> None:
    """df(text): one file per partition, folders made as needed."""
    df.select("text").write.mode("overwrite").text(path)


LABELS = "id string, set string, human boolean, judge boolean, note string"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a judge's calibration: id, set, human, judge, note."""
    return read_jsonl(spark, path, LABELS)


def write_report(df: DataFrame, path: str) -> int:
    """The rows of an evaluation as JSON lines."""
    return write_jsonl(df, path)


def read_reports(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Reports of several splits in one frame, each row with its split."""
    parts = [read_jsonl(spark, path, schema).withColumn("split", F.lit(split)) for split, path in sorted(paths.items())]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def report_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two reports that differ in a value, or stand in one only: the keys, before, after."""
    a, b = old.select(*keys, F.col(value).alias("before")), new.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def write_bundle(frames: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Each frame as JSON lines in a folder of its own below one folder; rows per frame."""
    return {name: write_jsonl(df, f"{folder}/{name}") for name, df in frames.items()}


def html_report(title: str, frames: dict[str, DataFrame], most: int = 1000) -> str:
    """A page of tables from aggregated frames. A frame of more than `most` rows is refused: reports show aggregates."""
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in frames.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        cells = lambda values, tag: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)
        body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{cells(df.columns, 'th')}</tr>{body}</table>")
    return "".join(parts) + "</body></html>"


def read_dotenv(text: str, known: dict[str, str]) -> dict[str, str]:
    """Settings of a .env text that aren't known yet: comments and `export` are skipped, quotes taken off."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if not sign or not name or name.startswith("#") or name in known:
            continue
        out[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of one graph document. Edges keep their order in edge_seq; equal ones are merged, their sources
    listed; an entity's rows are merged, aliases in first-seen order."""
    doc = spark.read.schema(GRAPH).json(path, multiLine=True)
    rows = doc.select(F.posexplode("entities").alias("seq", "e")).select("seq", "e.*")
    entities = rows.groupBy("id").agg(
        F.min_by("type", "seq").alias("type"), F.min_by("name", "seq").alias("name"), F.min_by("props", "seq").alias("props"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "aliases"))), lambda s: F.coalesce(s["aliases"], F.array().cast("array<string>"))))).alias("aliases"),
    )
    steps = doc.select(F.posexplode("edges").alias("edge_seq", "e")).select("edge_seq", "e.*")
    all_docs = F.concat(F.array("source_doc"), F.coalesce("extra_docs", F.array().cast("array<string>")))
    merged = steps.groupBy("src", "rel", "dst").agg(
        F.min("edge_seq").alias("edge_seq"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", all_docs.alias("docs")))), lambda s: s["docs"]))).alias("docs")
    )
    return entities, merged


def write_graph(entities: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as two tables; a single document doesn't scale."""
    entities.write.mode("overwrite").parquet(f"{folder}/entities.parquet")
    edges.write.mode("overwrite").parquet(f"{folder}/edges.parquet")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """id, base, system, user of Markdown prompt files with front matter; both sections must be there."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    meta = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    rows = files.select(
        F.regexp_extract("file", r"([^/]+/[^/]+)\.md$", 1).alias("id"), F.regexp_extract(meta, r"(?m)^base:\s*(\S+)", 1).alias("base"),
        F.regexp_extract(body, r"(?s)# system\s*\n\s*(.*?)\s*(?=\n# user|\z)", 1).alias("system"), F.regexp_extract(body, r"(?s)# user\s*\n\s*(.*?)\s*\z", 1).alias("user"),
    )
    whole = (F.col("system") != "") & (F.col("user") != "")
    return rows.select("id", F.nullif("base", F.lit("")).alias("base"), F.when(whole, F.col("system")).otherwise(F.raise_error(F.concat(F.lit("prompt without system or user: "), "id"))).alias("system"), "user")


def lineage(prompts: DataFrame) -> DataFrame:
    """id, root, steps: each prompt followed over `base` to its end; a cycle ends where it would repeat."""
    links = prompts.select(F.col("id").alias("at"), F.col("base").alias("next"))
    state, grows = prompts.select("id", F.array("id").alias("chain")), True
    while grows:
        rows = state.join(links, F.element_at("chain", -1) == F.col("at"), "left")
        extend = F.col("next").isNotNull() & ~F.array_contains("chain", F.col("next"))
        rows = cut(rows.select("id", F.when(extend, F.concat("chain", F.array("next"))).otherwise(F.col("chain")).alias("chain"), extend.alias("grown")))
        state, grows = rows.select("id", "chain"), not rows.where("grown").isEmpty()
    return state.select("id", F.element_at("chain", -1).alias("root"), (F.size("chain") - 1).alias("steps"))


def prompt_family(prompts: DataFrame) -> DataFrame:
    """prompts(id, base) -> family (the part before the slash), ids, sorted."""
    return prompts.groupBy(F.split_part("id", F.lit("/"), F.lit(1)).alias("family")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def chat_keys(messages: DataFrame) -> DataFrame:
    """messages(chat, seq, role, content, calls) -> chat, key, stable: hashes of a chat with and without what tools returned."""
    rows = messages.groupBy("chat").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content", "calls"))).alias("m"))
    bare = F.transform("m", lambda m: F.struct(m["seq"].alias("seq"), m["role"].alias("role"), F.when(m["role"] != "tool", m["content"]).alias("content"), m["calls"].alias("calls")))
    return rows.select("chat", F.sha2(F.to_json("m"), 256).alias("key"), F.sha2(F.to_json(bare), 256).alias("stable"))


def cache_key(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds `key`: the SHA-256 of the JSON of the fields in order of their names."""
    return df.withColumn("key", F.sha2(F.to_json(F.struct(*(F.col(f) for f in sorted(fields)))), 256))


def looked_up(requests: DataFrame, cache: DataFrame, aliases: DataFrame) -> DataFrame:
    """requests(key, alias), cache(key, text), aliases(alias, key) -> requests with text and alias_hit: the key first, then the alias."""
    once = cache.dropDuplicates(["key"])
    over = aliases.dropDuplicates(["alias"]).join(once, "key").select("alias", F.col("text").alias("by_alias"))
    rows = requests.join(once, "key", "left").join(over, "alias", "left")
    hit = F.col("text").isNull() & F.col("by_alias").isNotNull()
    return rows.withColumn("alias_hit", hit).withColumn("text", F.coalesce("text", "by_alias")).drop("by_alias")
