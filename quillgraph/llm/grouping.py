"""Problem 2: one group id for all records that are linked directly or over others.

Low-diameter decomposition: in each level every vertex draws a start from an exponential distribution and clusters grow from
the starts, one edge per round; a vertex joins the cluster that reaches it first. Each cluster contracts to one vertex,
edges between clusters form the next, much smaller graph, and the assignments of the levels are composed. The draws are
hashes of vertex and level, so a lost executor recomputes the same clusters. A level may stop growing after a fixed number
of rounds: a vertex is only ever assigned to a vertex it is connected with, so contraction keeps the components whatever
the rounds; they only set how fast the graph shrinks.

Every step is a join or an aggregation on vertex keys with partial aggregation before the shuffle; a vertex with very many
edges (one shared name) is a star whose minimum is pre-aggregated, never a list. Nothing is collected but counts.
A caller may name a number of edges that one task may join; the levels then end as soon as no more are left.

Edge cases: null ends are no link; a link of a vertex with itself puts it in a group of its own; repeated links and both
directions count once; an empty table gives no groups; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillgraph.plans import written
from quillgraph.sources import table

#: Rate of the exponential starts, and rounds of growth per level.
RATE, ROUNDS = 0.5, 3


def _start(vertex: str, level: int) -> F.Column:
    """When the cluster of a vertex starts: late draws start first."""
    u = (F.pmod(F.xxhash64(F.col(vertex), F.lit(level)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return F.log(u) / RATE


def grow(edges: DataFrame, level: int, rounds: int = ROUNDS) -> DataFrame:
    """edges(a, b), both directions -> vertex, center after `rounds` of growth."""
    labels = edges.select(F.col("a").alias("v")).distinct().select("v", F.struct(_start("v", level).alias("at"), F.col("v").alias("center")).alias("label"))
    for _ in range(rounds):
        near = edges.join(labels.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), F.struct((F.col("label.at") + 1.0).alias("at"), F.col("label.center").alias("center")).alias("label"))
        labels = labels.unionByName(near).groupBy("v").agg(F.min("label").alias("label"))
    return labels.select("v", F.col("label.center").alias("center"))


def joined(edges: DataFrame) -> DataFrame:
    """edges(a, b), few enough for one task -> v, center (the smallest vertex of its component)."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[object, object] = {}

        def top(v: object) -> object:
            while (up := above.setdefault(v, v)) != v:
                above[v] = v = above[up]
            return v

        for a, b in chain.from_iterable(zip(batch["a"], batch["b"], strict=True) for batch in batches):
            least, other = sorted((top(a), top(b)))
            above[other] = least
        yield pd.DataFrame([(v, top(v)) for v in list(above)], columns=["v", "center"])

    kind = edges.schema["a"].dataType
    return edges.coalesce(1).mapInPandas(join, StructType([StructField("v", kind), StructField("center", kind)]))


def components(links: DataFrame, rounds: int = ROUNDS, few: int = 0) -> DataFrame:
    """links(a, b) -> vertex, component (one vertex of each component) for every vertex with a link.

    Once a level has at most `few` edges, both directions counted, one task joins them all, instead of the many small jobs of
    the further levels, whose plans, stages and threads fill the driver's memory.
    """
    links = links.where("a is not null and b is not null").select("a", "b")
    edges = written(links.union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    assigned = written(links.select(F.col("a").alias("vertex")).union(links.select("b")).distinct().select("vertex", F.col("vertex").alias("component")), "assigned")
    level = 0
    while not edges.isEmpty():
        last = few > 0 and edges.count() <= few
        clusters = written(joined(edges) if last else grow(edges, level, rounds), "clusters")
        assigned = written(
            assigned.join(clusters.withColumnRenamed("v", "component"), "component", "left").select("vertex", F.coalesce("center", "component").alias("component")), "assigned"
        )
        if last:
            break
        edges = written(
            edges.join(clusters.select(F.col("v").alias("a"), F.col("center").alias("ca")), "a")
            .join(clusters.select(F.col("v").alias("b"), F.col("center").alias("cb")), "b")
            .where("ca <> cb")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            .distinct(),
            "edges",
        )
        level += 1
    return assigned


def grouped(records: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """records(id, names array), links(a, b between names) -> entity_id, group_id of the groups of two or more records.

    Records and names are the vertices of one graph. A name that one record alone holds and no link mentions can't join
    anything and is left out before the first level.
    """
    held = records.select("id", F.explode("names").alias("name")).where("id is not null and name <> ''").distinct()
    links = links.where("a <> '' and b <> ''").select("a", "b").distinct()
    mentioned = links.select(F.col("a").alias("name")).union(links.select("b")).distinct()
    shared = held.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    useful = held.join(shared.union(mentioned).distinct(), "name", "left_semi")
    graph = useful.select(F.concat(F.lit("r:"), "id").alias("a"), F.concat(F.lit("n:"), "name").alias("b")).union(links.select(F.concat(F.lit("n:"), "a"), F.concat(F.lit("n:"), "b")))
    found = components(graph, rounds).where("vertex like 'r:%'").select(F.expr("substring(vertex, 3)").alias("entity_id"), "component")
    ids = found.groupBy("component").agg(F.min("entity_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return found.join(ids, "component").select("entity_id", "group_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "entities").select("id", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("names"))
    links = table(spark, sf_dir, "triples").where("relation = 'ALIAS'").select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return grouped(records, links)


QUERIES = {"p2_found": p2_found}
SQL = {
    "p2_found": """
        WITH RECURSIVE held AS (
            SELECT DISTINCT id, n AS name FROM (
                SELECT id, name AS n FROM entities UNION ALL SELECT id, unnest(aliases) FROM entities) WHERE n <> ''),
        useful AS (
            SELECT * FROM held WHERE name IN (SELECT name FROM held GROUP BY name HAVING count(*) > 1)
               OR name IN (SELECT subject FROM triples WHERE relation = 'ALIAS' UNION SELECT object FROM triples WHERE relation = 'ALIAS')),
        edges AS (
            SELECT 'r:' || id AS a, 'n:' || name AS b FROM useful
            UNION SELECT 'n:' || name, 'r:' || id FROM useful
            UNION SELECT 'n:' || subject, 'n:' || object FROM triples WHERE relation = 'ALIAS' AND subject <> '' AND object <> ''
            UNION SELECT 'n:' || object, 'n:' || subject FROM triples WHERE relation = 'ALIAS' AND subject <> '' AND object <> ''),
        reach(v, w) AS (
            SELECT DISTINCT a, a FROM edges WHERE a LIKE 'r:%'
            UNION SELECT r.v, e.b FROM reach r JOIN edges e ON e.a = r.w)
        SELECT substring(v, 3) AS entity_id, min(substring(w, 3)) AS group_id FROM reach WHERE w LIKE 'r:%'
        GROUP BY v HAVING count(*) > 1"""
}
