import random

import pytest

from quillgraph.llm import leakage
from quillgraph.llm.leakage import chain, leaked, stream


def sentence(r, zh):
    if zh:
        return "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(r.randrange(12, 30))) + "。"
    return " ".join("".join(r.choice("abdeghiklmnorstuvz") for _ in range(r.randrange(3, 8))) for _ in range(10)) + ". "


def passage(r, zh, n=6):
    return "".join(sentence(r, zh) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    r = random.Random(1)
    return [(k, passage(r, k % 2 == 0)) for k in range(20)]


def noisy(r, text):
    out = []
    for ch in text:
        x = r.random()
        out.append("" if x < 0.01 else ch + r.choice(["\n", "　", "[3]", "<br/>"]) if x < 0.04 else ch)
    return "".join(out)


def test_passages_are_found(spark, items):
    r = random.Random(2)
    texts, want = [], set()
    for k, text in items:
        zh = k % 2 == 0
        texts.append(passage(r, zh) + text + passage(r, zh))
        want.add((len(texts) - 1, k))
        half = text[len(text) // 5 : len(text) // 5 + int(len(text) * 0.65)]
        texts.append(passage(r, zh) + noisy(r, half) + passage(r, zh))
        want.add((len(texts) - 1, k))
        texts.append(passage(r, zh) + text[: len(text) // 5] + passage(r, zh))
        texts.append(passage(r, zh, 12))
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in leaked(corpus, held).collect()} == want


def test_chain_looks_back_over_all_phrases():
    # a hundred short phrases inside the reach of a long one
    phrases = sorted([(0, 500, 0)] + [(480 + k // 10, 482 + k // 10, 90 + k) for k in range(100)] + [(505, 600, 0)])
    assert chain(phrases, 600, 24) == (595 / 600, 595)


def test_hot_term(spark, items):
    # a sentence of every item stands in a third of all documents
    r = random.Random(5)
    hot = sentence(r, True)
    held = [(k, t + hot) for k, t in items]
    docs = [(k, t + hot) for k, t in items] + [(100 + k, passage(r, True) + (hot if k % 3 == 0 else "")) for k in range(300)]
    found = leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(held, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == {(k, k) for k, _ in items}


def test_folding():
    assert "".join(map(chr, stream("Ｆoo［1］ [12]<b>舊</b>É-\nx"))) == "foo1旧ex"


def test_frame(spark, items):
    docs = [(1, "前言。" + items[0][1] + "后记。", "x"), (1, "前言。" + items[0][1] + "后记。", "x"), (2, None, "x"), (3, "", "x"), (4, items[1][1].upper(), "y")]
    corpus = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    held = spark.createDataFrame([*items, (98, None), (99, "短"), (100, items[0][1])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaked(corpus, held).collect()} == {(1, 0), (1, 100), (4, 1)}
    assert leaked(corpus.limit(0), held).count() == 0
    assert leaked(corpus, held.limit(0)).count() == 0


def test_a_full_filter_gives_the_same(spark, items, monkeypatch):
    corpus = spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leakage, "FILTER", 1 << 15)
    monkeypatch.setattr(leakage, "SMALL", 0)
    assert {(r.doc_id, r.item_id) for r in leaked(corpus, held).collect()} == {(k, k) for k, _ in items}
