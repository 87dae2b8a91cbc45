import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.splitting import pieces, sections, split_oversized


def rebuilt(parts):
    text = ""
    for at, _, piece in parts:
        assert at <= len(text)
        assert text[at:] == piece[: len(text) - at]
        text = text[:at] + piece
    return text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="一二、。\n ab.！́", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_rebuild_the_text(text, limit, overlap):
    parts = pieces(text, limit, overlap)
    assert rebuilt(parts) == text
    assert all(len(p) <= limit for _, _, p in parts)


def test_consecutive_pieces_of_a_section_share_the_overlap():
    text = "一、甲\n" + "".join(f"第{k}句话在这里结束。" for k in range(120)) + "\n二、乙\n短。"
    parts = pieces(text)
    assert [h for _, h, _ in parts][-1] == "二、乙"
    for (a, h, p), (b, g, _) in zip(parts, parts[1:]):
        if h == g:
            assert a + len(p) - b == 60
            assert p.endswith("。")


def test_a_text_without_boundaries_is_cut_at_the_limit():
    assert [len(p) for _, _, p in pieces("x" * 1000, 400, 60)] == [400, 400, 320]


def test_sections():
    assert [h for *_, h in sections("序\n一、甲\n二、乙\n")] == ["", "一、甲", "二、乙"]
    assert [h for *_, h in sections("一、甲\n")] == ["一、甲"]


def test_frame(spark):
    rows = [("a", None, "字" * 401, 1), ("b", "s", "字" * 400, 2), ("c", None, None, 3), ("d", "s", "", 4), ("e", "s", "y. " * 300, 5)]
    out = split_oversized(spark.createDataFrame(rows, "item_id string, section string, text string, piece_no int")).collect()
    assert {r.item_id for r in out} == {"a", "e"}
    assert {r.section for r in out if r.item_id == "e"} == {"s"}
    assert split_oversized(spark.createDataFrame([], "item_id string, section string, text string")).count() == 0
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame(rows, "item_id string, section string, text string, x int"), 10, 10)


def test_very_long():
    random.seed(1)
    text = "".join(random.choice("甲乙丙丁。\n") for _ in range(200_000))
    assert rebuilt(pieces(text)) == text


def test_pieces_begin_with_whole_characters():
    import unicodedata

    text = "e\u0301" * 1500
    cut = pieces(text)
    assert all(not unicodedata.combining(p[0]) for _, _, p in cut) and all(len(p) <= 400 for _, _, p in cut)
    assert all(a + len(p) - b in (60, 61) for (a, _, p), (b, _, _) in zip(cut, cut[1:], strict=False))
    assert text == "".join([cut[0][2], *(p[a + len(q) - b :] for (a, _, q), (b, _, p) in zip(cut, cut[1:], strict=False))])
