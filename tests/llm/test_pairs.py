import random

import numpy as np
import pytest

from quillgraph.llm import grouping, pairs
from quillgraph.llm.pairs import completeness, count_endings, defects, folded, is_copy, is_empty, language, links, opening, templates, tokens

TEXTS = ["", "  ​", "……", "[1]", "[2][3]", "答：", "-", "\n\n[4]", None, " ", "Answer:"]


@pytest.mark.parametrize("text", TEXTS)
def test_empty(text):
    assert is_empty(text)


def test_not_empty():
    assert not is_empty("白鹭") and not is_empty("答：白鹭") and not is_empty("12")


def test_copy():
    q = "在《书》里，阿明·川远的武器是什么？"
    assert is_copy(folded(q), tokens(folded(q))) and is_copy(folded("您问的是：" + q + " " + q), tokens(folded(q)))
    assert is_copy(folded("在《书》里，阿明·川远的武器是什么。[1]"), tokens(folded(q)))
    assert not is_copy(folded("阿明·川远的武器是铁锹。"), tokens(folded(q)))
    assert not is_copy(folded("在《书》里，阿明·川远的武器是"), tokens(folded(q)))


def test_language():
    assert language("The answer is on the first page.", []) == "en"
    assert language("Das steht auf der ersten Seite.", []) == "de"
    assert language("La réponse est dans le profil.", []) == "fr"
    assert language("そのことは最初のページにはっきりと書かれています。", []) == "ja"
    assert language("答案写在第一页。", []) == "zh"
    assert language("“Mind the ladder”", []) is None


def test_opening_masks_the_question():
    q = tokens("阿明·川远的武器是什么")
    assert opening("无法确定阿明·川远的武器，文档没有线索。多余", q) == "无 法 确 定 ■ 文 档 没 有 线 索"


def test_frame(spark):
    names = [f"阿{a}·{b}远" for a in "明音黎佩胡贝" for b in "川岭霍汀"]
    questions = [(f"q{k}", f"{n}的武器是什么？", "铁锹", False) for k, n in enumerate(names)]
    questions += [("e1", "What is the weapon of Dalin Morvek?", "spade", False), ("r1", "阿明·川远的身高是什么？", "n/a", True)]
    answers = [(f"a{k}", f"q{k}", f"根据资料，{n}的武器是铁锹[{k % 9}]。", False, None) for k, n in enumerate(names)]
    answers += [(f"n{k}", f"q{k}", f"无法确定{n}的武器，文档没有线索。", k % 4 != 0, None) for k, n in enumerate(names[:8])]
    answers += [
        ("x1", "q1", None, False, None), ("x2", "q1", "您问的是：" + questions[1][1], None, None), ("x3", "q1", "The answer is on the first page.", True, None),
        ("x4", "e1", "Die Waffe steht auf der zweiten Seite.", None, None), ("x5", "q1", f"根据资料，{names[1]}的武器是铁锹[1]，不过需要", None, "k1"),
        ("x6", "q1", "铁锹", None, "k1"), ("x7", "r1", "无法确定阿明·川远的身高，文档没有线索。", True, None), ("x8", "none", "铁锹。", None, None), ("x6", "q1", "铁锹", None, "k1"),
        ("x9", "e1", "The weapon of Dalin Morvek is spade. [1]（旁注：没有别的意思）", None, None),
    ]
    frames = (
        spark.createDataFrame([(*a, "z") for a in answers], "answer_id string, question_id string, text string, refused boolean, result_key string, defect string"),
        spark.createDataFrame(questions, "id string, question string, gold_answer string, expect_refusal boolean"),
        spark.createDataFrame([("k1", "length"), ("k1", "length"), (None, "stop")], "result_key string, finish_reason string"),
    )
    want = {f"n{k}": "refusal" for k in range(8)} | {"x1": "empty", "x2": "copied", "x3": "wrong_language", "x4": "wrong_language", "x5": "truncated"}
    out = defects(*frames).collect()
    assert {r.answer_id: r.defect for r in out} == want and len(out) == len(want)
    assert defects(frames[0].limit(0), *frames[1:]).count() == 0


def test_an_ending_of_five_words_decides(spark):
    texts = ["eins zwei drei vier fünf."] * 4 + ["alpha beta drei vier fünf sechs."] * 36
    counts = count_endings(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert completeness("eins zwei drei vier fünf", None, counts) == 1.0
    assert completeness("alpha beta drei vier fünf", None, counts) == 0.0


def test_openings_at_the_threshold_meet(spark):
    """Pairs at the least similarity: none of them is lost."""
    draw, rows = random.Random(3), []
    for k in range(1500):
        own = [chr(0x4E00 + draw.randrange(20_000)) for _ in range(29)]
        rows += [("".join(x), f"q{k}.{j}.{n}", True) for j, x in enumerate((own, [*own[:-3], "甲", "乙", "丙"])) for n in range(3)]
    found = templates(spark.createDataFrame(rows, "opening string, question_key string, refused boolean"))
    assert found.count() == 3000


def test_variants_reach_their_template_over_others(spark):
    """A chain of variants, of which only neighbours are near, is one template."""
    draw = random.Random(5)
    text, rows = [chr(0x4E00 + draw.randrange(20_000)) for _ in range(40)], []
    for k in range(12):
        rows.append(("".join(text), f"q{k}", True))
        text = [*text[: 3 * k], "甲", *text[3 * k + 1 :]]
    found = templates(spark.createDataFrame(rows, "opening string, question_key string, refused boolean")).collect()
    assert len(found) == 12 and len({r.template for r in found}) == 1


def test_blocks_lose_no_link(spark):
    common = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    rows = [(k, common[:j] + chr(0x6E00 + k) + common[j:]) for k, j in enumerate([5, 20, 40] * 20)]
    classes = spark.createDataFrame(rows, "key long, opening string")
    for size in (4, 512):
        reached, found = {0}, [(r.a, r.b) for r in links(classes, size).collect()]
        while more := {x for ends in found if reached & set(ends) for x in ends} - reached:
            reached |= more
        assert reached == set(range(60)), size


def test_count_tables_reach_the_driver_in_blocks(spark, monkeypatch):
    """However many endings and triples there are, the driver gets no row for each; the counts are those of all texts."""
    draw = random.Random(7)
    texts = ["".join(chr(0x4E00 + draw.randrange(20_000)) for _ in range(300)) + "。" for _ in range(60)] * 3
    frame, sizes = spark.createDataFrame([(t,) for t in texts], "text string"), []
    kind = type(frame)
    for name in ("collect", "toPandas"):

        def counted(self, own=getattr(kind, name)):
            rows = own(self)
            sizes.append(len(rows))
            return rows

        monkeypatch.setattr(kind, name, counted)
    counts = count_endings(frame)
    triples = pairs._counted(frame.selectExpr("text AS opening"), lambda own: pairs._cells(pairs.grams(own)[1]))
    assert len(sizes) >= 2 and max(sizes) <= 1024
    # of 300 characters that follow one another 300, 299, 298 and 296 end a run of 1, 2, 3 and 5, and the last of each stands before a stop
    assert counts.dtype == np.float32 and counts[0].sum() == 180 * (300 + 299 + 298 + 296) and counts[1].sum() == 180 * 4
    assert triples.sum() == sum(len(set(zip(t, t[1:], t[2:], strict=False))) for t in texts)
    assert (triples == np.bincount(pairs._cells(pairs.grams(texts)[1]), minlength=len(triples))).all()
    assert count_endings(frame.limit(0)).sum() == 0


def test_small_inputs_take_little_of_the_driver(spark, monkeypatch):
    """The count tables of a few texts reach the driver as few bytes, and a chain of openings as one level of clusters."""
    draw, labels, sizes, own = random.Random(11), [], [], grouping.written
    text, rows = [chr(0x4E00 + draw.randrange(20_000)) for _ in range(90)], []
    for k in range(28):
        rows += [("".join(text) + "。", f"q{k}", True)] * 3
        text = [*text[: 3 * k], "甲", *text[3 * k + 1 :]]
    frame = spark.createDataFrame(rows, "opening string, question_key string, refused boolean")
    kind = type(frame)

    def counted(self, collect=kind.collect):
        out = collect(self)
        sizes.append(sum(len(r.cells) for r in out if "cells" in r))
        return out

    def labelled(df, label="stage"):
        labels.append(label)
        return own(df, label)

    monkeypatch.setattr(grouping, "written", labelled)
    monkeypatch.setattr(kind, "collect", counted)
    assert count_endings(frame.selectExpr("opening AS text"))[0].sum() > 0
    found = templates(frame)
    assert len(sizes) == 3 and 0 < sum(sizes) < 1 << 20
    assert labels.count("clusters") == 1
    out = found.toPandas()
    assert len(out) == 28 and out["template"].nunique() == 1
