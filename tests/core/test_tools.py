from datetime import datetime

from quillgraph.operators.tools import Tools
from quillgraph.streaming import term_counts


def test_tools(spark):
    entities = spark.createDataFrame([("E1", "Character", "Ann", ["Annie"]), ("E2", "Character", "Joanna", None), ("E3", "Place", "Mill", [])], "id string, entity_type string, name string, aliases array<string>")
    triples = spark.createDataFrame([("T1", "Ann", "LIVES_IN", "Mill", "Place", "d1"), ("T2", "Joanna", "LIVES_IN", "Mill", "Place", "d1"), ("T3", "Ann", "ROLE", "cook", "Literal", "d1")], "triple_id string, subject string, relation string, object string, object_type string, source_doc string")
    texts = spark.createDataFrame([("c1", "Ann runs the mill"), ("c2", "nothing"), ("c2", "nothing"), ("c3", None)], "id string, text string")
    tools = Tools(entities, triples, texts, texts)
    assert [(r.id, r.match) for r in tools.find_entity("ann").collect()] == [("E1", 0), ("E2", 1)]
    assert [r.other for r in tools.get_neighbors("Ann", "LIVES_IN").collect()] == ["Mill"]
    assert [r.path for r in tools.find_paths("Ann", "Joanna").collect()] == ["Ann -[LIVES_IN]-> Mill <-[LIVES_IN]- Joanna"]
    assert tools.explain_relation("Ann", "Nobody").count() == 0
    assert [(r.subject, r.total) for r in tools.list_by_relation("LIVES_IN", "mill").collect()] == [("Ann", 2), ("Joanna", 2)]
    assert [r.item for r in tools.search_text("mill").collect()] == ["c1"]
    assert [(r.body, r.truncated) for r in tools.read_document("c1", 3).collect()] == [("Ann", True)]
    assert {r.rel: r.edges for r in tools.schema().collect()} == {"LIVES_IN": 2, "ROLE": 1}


def test_stream(spark, tmp_path):
    rows = [("1", "red fox red", datetime(2024, 1, 1, 10, 5)), ("2", "red", datetime(2024, 1, 1, 10, 50)), ("3", None, datetime(2024, 1, 1, 11, 5)), ("4", "fox", datetime(2024, 1, 1, 11, 6))]
    frame = spark.createDataFrame(rows, "id string, text string, at timestamp")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run = term_counts(stream).writeStream.format("memory").queryName("terms").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.start.hour, r.term, r.df, r.cf) for r in spark.table("terms").collect())
    assert got == [(10, "fox", 1, 1), (10, "red", 2, 3), (11, "fox", 1, 1)]
