"""The tool API: each tool is one parameterised frame over the graph or the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R


class Tools:
    """entities(id, entity_type, name, aliases), triples, chunks(id, text), documents(id, text)."""

    def __init__(self, entities: DataFrame, triples: DataFrame, chunks: DataFrame, documents: DataFrame):
        self.entities, self.triples, self.chunks, self.documents = entities.dropDuplicates(["id"]), triples, chunks.dropDuplicates(["id"]), documents
        self.edges = G.edges_of(triples)

    def find_entity(self, name: str, limit: int = 5) -> DataFrame:
        """Exact id, name or alias first, then names and aliases that contain it, in order of id."""
        norm = T.normal_name(F.lit(name))
        forms = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
        exact = (F.col("id") == name) | F.exists(forms, lambda f: T.normal_name(f) == norm)
        part = F.exists(forms, lambda f: F.contains(F.lower(f), F.lit(name.lower())))
        ranked = self.entities.withColumn("match", F.when(exact, 0).when(part, 1)).where("match is not null")
        return ranked.orderBy("match", "id").limit(limit).select("id", "entity_type", "name", "aliases", "match")

    def get_neighbors(self, entity: str, relation: str | None = None, limit: int = 30) -> DataFrame:
        edges = self.edges if relation is None else self.edges.where(F.col("rel") == relation)
        return G.neighbours(edges, self.entities.sparkSession.createDataFrame([(entity,)], "node string"), limit)

    def find_paths(self, source: str, target: str, max_hops: int = 4, limit: int = 5, hubs_block: bool = False) -> DataFrame:
        """Hubs may be passed; hops are held between 1 and 5."""
        pair = self.entities.sparkSession.createDataFrame([("p", source, target)], "pair string, source string, target string")
        return G.find_paths(self.edges, pair, min(5, max(1, max_hops)), limit, hubs_block).select("hops", "path", "place")

    def explain_relation(self, a: str, b: str, max_hops: int = 4) -> DataFrame:
        return self.find_paths(a, b, max_hops, 12, hubs_block=True)

    def list_by_relation(self, relation: str, value: str | None = None, limit: int = 50) -> DataFrame:
        """subject, object, total: rows whose object equals the value by normal form or contains it."""
        rows = self.triples.where((F.col("relation") == relation) & F.col("object").isNotNull())
        if value is not None:
            rows = rows.where((T.normal_name(F.col("object")) == T.normal_name(F.lit(value))) | F.contains(F.col("object"), F.lit(value)))
        rows = rows.select("subject", "object").distinct()
        return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).orderBy("subject", "object").limit(limit)

    def search_text(self, query: str, top_k: int = 5) -> DataFrame:
        """Lexical search with snippets of 220 characters; 1 to 10 hits."""
        asked = self.entities.sparkSession.createDataFrame([("q", query)], "query string, text string")
        items = self.chunks.select(F.col("id").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
        hits = R.bm25(items, asked, min(10, max(1, top_k))).join(items, "item")
        return hits.select("item", F.round("score", 4).alias("score"), "rank", F.substring("text", 1, 220).alias("snippet"))

    def read_document(self, doc_id: str, max_chars: int = 1500) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        return self.documents.where(F.col("id") == doc_id).select("id", F.substring(text, 1, max_chars).alias("body"), (F.length(text) > max_chars).alias("truncated"))

    def schema(self) -> DataFrame:
        """Relations with their numbers of edges."""
        return self.edges.groupBy("rel").agg(F.count("*").alias("edges"))
