import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import answering as A
from quillgraph.operators import chunking as C
from quillgraph.operators import extraction as X
from quillgraph.plans import lineage
from quillgraph.sources import documents as D


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first().v


def test_full_scores(spark):
    questions = spark.createDataFrame([("q1", "t", ["阿明", "红灯"], ["d1"], False), ("q2", "trap", [], [], True)], "id string, qtype string, gold_entities array<string>, gold_docs array<string>, expect_refusal boolean")
    entities = spark.createDataFrame([("E1", "阿明", ["小明", ""])], "id string, name string, aliases array<string>")
    cite = lambda *c: [(n, "c", d, v) for n, d, v in c]
    rows = [
        ("a1", "q1", "p", "小明 的 红 灯[1]", cite((1, "d1", True), (2, "d2", True), (3, None, False))), ("a2", "q1", "p", "资料中未提及阿明。", None), ("a3", "q2", "p", "无法确定。", []), ("a4", "q2", "p", "是红色。doc-00000001", []),
    ]
    answers = spark.createDataFrame(rows, "answer_id string, question_id string, prompt_id string, text string, citations array<struct<idx:int,chunk_id:string,doc_id:string,valid:boolean>>").withColumns({"latency_ms": F.lit(1.0), "cost_usd": F.lit(0.5)})
    got = {r.answer_id: tuple(r)[4:11] for r in A.fully_scored(answers, questions, entities).collect()}
    # refused, entity_recall, correct, refusal_correct, false_refusal, citation_valid, citation_grounded
    assert got["a1"] == (False, 1.0, 1.0, None, 0.0, 0.666667, 0.5)
    assert got["a2"] == (True, 0.5, 0.0, None, 1.0, None, None)
    assert got["a3"] == (True, None, 1.0, 1.0, None, None, None) and got["a4"] == (False, None, 0.0, 0.0, None, None, None)


def test_recall_at_twenty(spark):
    ranked = spark.createDataFrame([("q", f"c{k}", k) for k in range(1, 21)], "query string, item string, rank int")
    owners = spark.createDataFrame([(f"c{k}", f"d{k}") for k in range(1, 21)], "item string, doc string")
    gold = spark.createDataFrame([("q", "t", ["d2", "d15", "d99"])], "query string, qtype string, docs array<string>")
    row = A.retrieval_metrics(ranked, owners, gold).first()
    assert (row.recall_1, row.recall_3, row.recall_10, row.recall_20, row.hit_20, row.rr) == (0.0, 0.333333, 0.333333, 0.666667, 1, 0.5)


def test_answers_without_hits_and_paths(spark):
    asked = spark.createDataFrame([("q1",), ("q2",)], "query string")
    ranked = spark.createDataFrame([("q1", "c", 1)], "query string, item string, rank int")
    chunks = spark.createDataFrame([("c", "a\nb")], "item string, raw_text string")
    assert {r.query: (r.answer, r.refused) for r in A.extractive_or_refusal(asked, ranked, chunks).collect()} == {"q1": ("a b[1]", False), "q2": ("资料中未提及。", True)}
    contexts = spark.createDataFrame([("q1", "text"), ("q2", "text")], "query string, context string")
    paths = spark.createDataFrame([("q1", f"p{k}", k) for k in range(1, 9)], "query string, path string, place int")
    got = {r.query: r.context for r in A.with_paths(contexts, paths).collect()}
    assert got == {"q1": "text\n\n" + "\n".join(f"- p{k}" for k in range(1, 7)), "q2": "text"}


def test_text_functions(spark):
    assert one(spark, T.salvaged_json(F.col("t")), t='so:\n```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, T.salvaged_json(F.col("t")), t='x {"a": {"b": 2}} y') == '{"a": {"b": 2}}'
    assert one(spark, T.salvaged_json(F.col("t")), t="none { here") is None
    assert one(spark, T.document_ids(F.col("t")), t="doc-00000002, doc-00000001, doc-00000002") == ["doc-00000002", "doc-00000001"]
    assert one(spark, T.rendered("{{x}} {a}-{b}", a=F.col("a"), b=F.col("b")), a="1", b="2") == "{x} 1-2"
    with pytest.raises(KeyError):
        T.rendered("{missing}")
    assert one(spark, T.judged(F.col("t")), t='{"correct": true}') is True and one(spark, T.judged(F.col("t")), t="correct: false, I think") is False and one(spark, T.judged(F.col("t")), t="?") is None
    key = one(spark, T.edge_key(F.col("a"), F.lit("FRIEND_OF"), F.col("b")), a="b", b="a")
    assert (key.src, key.rel, key.dst) == ("a", "FRIEND_OF", "b") and one(spark, T.literal_key(F.col("a")), a="lit:Ab 3。") == "lit:ab3"
    assert one(spark, T.percent(F.lit(0.1234)), t="") == "12.3%" and one(spark, T.percent(F.lit(None).cast("double")), t="") == "—"
    assert one(spark, T.four_grams(F.col("t")), t="谁在河边钓鱼？") == ["在河边钓", "河边钓鱼"] and one(spark, T.four_grams(F.col("t")), t="谁？") == []
    assert one(spark, T.compact_json("t", "u"), t="甲", u=None) == '{"t":"甲","u":null}'
    assert one(spark, T.token_cost(F.lit(1_000_000), F.lit(500_000), F.lit(2.0), F.lit(4.0), F.lit(False)), t="") == 4.0


def test_evidence_without_parts(spark):
    docs = spark.createDataFrame([("d", "甲 在河边")], "id string, text string")
    rows = spark.createDataFrame([("T1", "d", "甲"), ("T2", "d", "乙"), ("T3", "d", " "), ("T4", "d", "甲·河边")], "triple_id string, source_doc string, evidence string")
    assert {r.triple_id: (r.parts, r.verbatim) for r in X.evidenced(rows, docs).collect()} == {"T1": (1, True), "T2": (1, False), "T3": (0, True), "T4": (1, True)}


def test_sections_are_stripped_and_prefixed(spark):
    docs = spark.createDataFrame([("d", "题", "一、甲\n　　" + "字" * 390 + "。" + "尾" * 50 + "\n\n二、乙\n后")], "doc_id string, title string, text string")
    rows = C.chunked(docs, "contextual").orderBy("chunk_seq").collect()
    assert [r.section for r in rows] == ["一、甲", "一、甲", "二、乙"] and rows[0].raw_text.startswith("一、甲\n") and rows[2].raw_text == "二、乙\n后"
    assert rows[0].text.startswith("【题】") and rows[1].text.startswith("【题｜一、甲】") and rows[1].raw_text.endswith("尾")


def test_files(spark, tmp_path):
    frame = spark.createDataFrame([("a", True), ("乙", None)], "id string, human boolean")
    assert D.write_jsonl(frame, str(tmp_path / "rows")) == 2
    assert {(r.id, r.human) for r in D.read_labels(spark, str(tmp_path / "rows")).collect()} == {("a", True), ("乙", None)}
    assert D.write_bundle({"one": frame, "two": frame.limit(1)}, str(tmp_path / "bundle")) == {"one": 2, "two": 1}
    both = D.read_reports(spark, {"dev": str(tmp_path / "bundle/one"), "test": str(tmp_path / "bundle/two")}, "id string, human boolean")
    assert both.groupBy("split").count().count() == 2 and both.count() == 3
    changed = D.report_changes(both.where("split = 'dev'"), both.where("split = 'test'"), ["id"], "human").collect()
    assert [(r.id, r.before, r.after) for r in changed] in ([], [("a", True, None)], [("乙", None, None)]) or len(changed) == 1
    D.write_text(spark.createDataFrame([("行",)], "text string"), str(tmp_path / "deep/text"))
    assert [r.text for r in D.read_text(spark, str(tmp_path / "deep/text")).collect()] == ["行\n"]
    assert "<td>乙</td>" in D.html_report("报告", {"t": frame})
    with pytest.raises(ValueError):
        D.html_report("x", {"t": frame}, most=1)
    assert D.read_dotenv("# c\nexport A='1'\nB=2\nC=x=y\nbad\n", {"B": "0"}) == {"A": "1", "C": "x=y"}


def test_lineage_without_end(spark):
    chain = [(f"p/{k}", f"p/{k - 1}" if k else None) for k in range(30)] + [("c/a", "c/b"), ("c/b", "c/a")]
    rows = {r.id: (r.root, r.steps) for r in D.lineage(spark.createDataFrame(chain, "id string, base string")).collect()}
    assert rows["p/29"] == ("p/0", 29) and rows["c/a"] == ("c/b", 1)
    assert {r.family: len(r.ids) for r in D.prompt_family(spark.createDataFrame(chain, "id string, base string")).collect()} == {"p": 30, "c": 2}


def test_chat_keys(spark):
    rows = [("x", 1, "user", "hi", None), ("x", 2, "tool", "0.51", None), ("y", 1, "user", "hi", None), ("y", 2, "tool", "0.52", None)]
    keys = {r.chat: (r.key, r.stable) for r in D.chat_keys(spark.createDataFrame(rows, "chat string, seq int, role string, content string, calls string")).collect()}
    assert keys["x"][0] != keys["y"][0] and keys["x"][1] == keys["y"][1]


def test_a_cluster_must_name_the_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return self

        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())
