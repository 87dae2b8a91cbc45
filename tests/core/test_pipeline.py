import pytest

from quillgraph.operators import answering as A
from quillgraph.operators import chunking as C
from quillgraph.operators import extraction as X
from quillgraph.sources import documents as D


def test_windows():
    assert list(C.windows("x" * 350, 350, 60)) == [(0, "x" * 350)]
    assert [(a, len(t)) for a, t in C.windows("x" * 700, 350, 60)] == [(0, 350), (290, 350), (580, 120)]
    text = "y" * 250 + "。" + "y" * 300
    assert [(a, len(t)) for a, t in C.windows(text, 350, 60)] == [(0, 251), (191, 350), (481, 70)]
    assert list(C.windows("   ", 350, 60)) == []


def test_sections():
    head = "序" * 120
    assert [s[0] for s in C.sections(head + "\n一、甲\n二、乙\n")] == ["一、甲", "二、乙"]
    assert [s[0] for s in C.sections(head + "言\n一、甲\n")] == ["", "一、甲"]
    assert C.sections("无标题") == [("", 0, 3)]


def test_chunked(spark):
    docs = spark.createDataFrame([("d1", "T", "一、甲\n内容。"), ("d2", None, None), ("d3", "U", "plain")], "doc_id string, title string, text string")
    rows = {r.chunk_id: r.text for r in C.chunked(docs, "contextual").collect()}
    assert rows == {"d1#c00": "【T】\n一、甲\n内容。", "d3#c00": "【U】\nplain"}
    with pytest.raises(ValueError):
        C.chunked(docs, "other")


def test_tags_and_facts(spark):
    rows = [("T1", "甲", "Character", "ROLE", "厨师", "Literal", "d"), ("T2", "甲", "Place", "ROLE", "厨师", "Literal", "d"), ("T3", "甲", "Character", "NOPE", "x", "Literal", "d"), ("T4", "", "Character", "ROLE", "x", "Literal", "d"), ("T5", "甲", None, "ROLE", "厨师", "Literal", "d")]
    frame = spark.createDataFrame(rows, "triple_id string, subject string, subject_type string, relation string, object string, object_type string, source_doc string")
    assert {r.triple_id: r.reason for r in X.tagged(frame).collect()} == {"T1": "ok", "T2": "wrong_type", "T3": "unknown_relation", "T4": "empty_name", "T5": "wrong_type"}
    assert sorted(r.triple_id for r in X.first_facts(frame).collect()) == ["T1", "T3", "T4"]


def test_evidence(spark):
    docs = spark.createDataFrame([("d", "他 住在　河边 的小屋。")], "id string, text string")
    rows = [("T1", "d", "住在河边"), ("T2", "d", "他·小屋"), ("T3", "d", None), ("T4", "d", "他住在河边的大屋"), ("T5", "d", "完全不同的话")]
    frame = spark.createDataFrame(rows, "triple_id string, source_doc string, evidence string")
    assert {r.triple_id: r.verbatim for r in X.evidenced(frame, docs).collect()} == {"T1": True, "T2": True, "T3": True, "T4": False, "T5": False}
    assert {r.triple_id: r.accepted for r in X.nearly_evidenced(frame, docs, 0.6).collect()} == {"T4": True, "T5": False}


def test_constrained_clusters(spark):
    rows = [("b", "a", "c", "0", True), ("b", "a", "bb", "1", False), ("b", "bb", "c", "2", False), ("x", "p", "q", "1", False)]
    got = {(r.block, r.name): r.representative for r in X.constrained_clusters(spark.createDataFrame(rows, "block string, a string, b string, seq string, forbid boolean")).collect()}
    assert got == {("b", "a"): "bb", ("b", "bb"): "bb", ("b", "c"): "c", ("x", "p"): "p", ("x", "q"): "p"}


def test_context_budget(spark):
    frame = lambda *sizes: spark.createDataFrame([("q", k + 1, "t", "x" * (n - 11)) for k, n in enumerate(sizes)], "query string, place int, title string, raw_text string")
    pack = lambda *sizes: [(r.blocks, r.characters) for r in A.packed_context(frame(*sizes)).collect()]
    base = len("[1]（来源：t）\n") - 11
    assert pack(9000 - base, 20) == [(1, 9000)] and pack(9999, 20)[0][0] == 1 and pack(4000, 4000, 4000)[0][0] == 2


def test_citations_and_scores(spark):
    answers = spark.createDataFrame([("a1", "q1", "p", "见[2][2][9] 甲。", ["c1", "c2"]), ("a2", "q2", "p", "未提及", None), ("a3", "q1", "p", "未提及甲", [])], "answer_id string, question_id string, prompt_id string, text string, context_chunks array<string>")
    assert sorted((r.answer_id, r.idx, r.chunk_id, r.valid) for r in A.citations(answers).collect()) == [("a1", 2, "c2", True), ("a1", 9, None, False)]
    questions = spark.createDataFrame([("q1", "t", ["甲"], False), ("q2", "t", [], True)], "id string, qtype string, gold_entities array<string>, expect_refusal boolean")
    got = {r.answer_id: (r.refused, r.correct, r.refusal_correct, r.false_refusal) for r in A.scored(answers, questions).collect()}
    assert got == {"a1": (False, 1.0, None, 0.0), "a2": (True, 1.0, 1.0, None), "a3": (True, 1.0, None, 0.0)}


def test_files(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id":"1","text":"甲"}\n\n  {"id":"2"}  \n', encoding="utf-8")
    rows = D.read_jsonl(spark, str(tmp_path / "d.jsonl"))
    assert [(r.id, r.text) for r in rows.collect()] == [("1", "甲"), ("2", None)]
    D.write_jsonl(rows, str(tmp_path / "out"))
    assert [(r.id, r.text) for r in D.read_jsonl(spark, str(tmp_path / "out")).orderBy("id").collect()] == [("1", "甲"), ("2", None)]
    (tmp_path / "g.json").write_text('{"entities":[{"id":"e","type":"T","name":"n","aliases":["x"]},{"id":"e","type":"T","name":"m","aliases":["y","x"]}],"edges":[{"src":"e","rel":"R","dst":"f","source_doc":"1"},{"src":"e","rel":"R","dst":"f","source_doc":"2"}]}')
    entities, edges = D.read_graph(spark, str(tmp_path / "g.json"))
    assert [(r.id, r.name, r.aliases) for r in entities.collect()] == [("e", "n", ["x", "y"])] and [(r.edge_seq, r.docs) for r in edges.collect()] == [(0, ["1", "2"])]
    folder = tmp_path / "prompts" / "answer"
    folder.mkdir(parents=True)
    for name, base in (("v1", ""), ("v2", "base: answer/v1\n")):
        (folder / f"{name}.md").write_text(f"---\nname: {name}\n{base}---\n# system\nBe brief.\n\n# user\n{{question}}\n")
    prompts = D.read_prompts(spark, str(tmp_path / "prompts" / "*" / "*.md"))
    assert sorted((r.id, r.base, r.system, r.user) for r in prompts.collect()) == [("answer/v1", None, "Be brief.", "{question}"), ("answer/v2", "answer/v1", "Be brief.", "{question}")]
    assert {r.id: (r.root, r.steps) for r in D.lineage(prompts).collect()} == {"answer/v1": ("answer/v1", 0), "answer/v2": ("answer/v1", 1)}


def test_cache(spark):
    requests = D.cache_key(spark.createDataFrame([("m", "p1", "x"), ("m", "p2", "y"), ("m", "p3", "z")], "model string, prompt string, alias string"), ["prompt", "model"])
    keys = {r.prompt: r.key for r in requests.collect()}
    cache = spark.createDataFrame([(keys["p1"], "one"), ("other", "two")], "key string, text string")
    aliases = spark.createDataFrame([("y", "other"), ("x", "other")], "alias string, key string")
    assert {r.prompt: (r.text, r.alias_hit) for r in D.looked_up(requests, cache, aliases).collect()} == {"p1": ("one", False), "p2": ("two", True), "p3": (None, False)}
