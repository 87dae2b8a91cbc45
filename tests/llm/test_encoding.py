import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import encoding
from quillgraph.llm.encoding import mend, restore, suspicious, train

SUBJECTS = ["邮差", "木匠", "老师", "渔夫", "面包师傅", "钟表匠", "林务员", "门房"]
PLACES = ["旧码头", "钟楼里", "石桥下面", "河湾的磨坊", "山顶的小屋", "雪后的村口"]
VERBS = ["捡到一只铁锹", "修好了水车", "讲完了那个故事", "遇见了一位老朋友", "把灯笼挂在门口", "数了七遍台阶"]


def clean_texts(n=3000, seed=3):
    r = random.Random(seed)
    zh = ["，".join([r.choice(SUBJECTS) + "在" + r.choice(PLACES), r.choice(VERBS)]) + "。" for _ in range(n)]
    de = [r.choice(["Der Käfer", "Die Müllerin", "Das Mädchen"]) + r.choice([" läuft über die Brücke", " hört die Glocke", " möchte süße Klöße"]) + "." for _ in range(n)]
    fr = [r.choice(["L’été", "La forêt", "Le métier"]) + r.choice([" était passé", " a été oublié", " reste très fatigué"]) + "." for _ in range(n)]
    return zh + de + fr


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.createDataFrame([(t,) for t in clean_texts()] + [(None,), ("",)], "text string"))


CHAINS = [("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("gb18030", "latin-1")]


@pytest.mark.parametrize("true, seen", CHAINS)
def test_garbled_text_is_restored(model, true, seen):
    good = tried = 0
    for text in clean_texts(60, seed=8):
        try:
            garbled = text.encode(true).decode(seen)
        except UnicodeError:
            continue
        if true == "utf-8" or text[0] > "一":
            good += suspicious(garbled) and restore(garbled, model)[0] == text
            tried += 1
    assert tried and good >= 0.9 * tried


def test_lossy_garbling_is_restored_for_the_most_part(model):
    for text in clean_texts(40, seed=9)[:40]:
        garbled = text.encode().decode("gb18030", "replace")
        restored, _, n = restore(garbled, model)
        assert suspicious(garbled) and n
        assert SequenceMatcher(None, text, restored, False).ratio() > 0.7


def test_garbled_twice(model):
    text = "木匠在石桥下面，修好了水车。"
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    assert restore(twice, model)[0] == text


def test_the_margin_leaves_clean_texts_alone(model):
    for text in [*clean_texts(200, seed=5), "The letter “Â” was missing.", "MAÇÃ” on the door", "招牌写着 Рынок，旁边画了一条鱼。", "木匠递来一把锛子，又打了√。", "涓流过河，鏈锁还挂在门上。", "nur noch ein „Ä“ und ein „Ö“"]:
        assert not suspicious(text) or restore(text, model)[2] == 0, text


def test_frame(spark, model):
    rows = [(1, "木匠在旧码头，修好了水车。" + "邮差在钟楼里".encode().decode("latin-1") + "。", "x"), (2, None, "x"), (3, "", "x"), (4, "木匠在旧码头。", "x"), (5, "������瘜Ｘ����������曄�", "x")]
    got = {r.doc_id: r for r in mend(spark.createDataFrame(rows, "doc_id long, text string, chains string"), model).collect()}
    assert set(got) == {1, 5}
    assert got[1].restored == "木匠在旧码头，修好了水车。邮差在钟楼里。" and got[1].whole
    assert not got[5].whole
    assert mend(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_an_empty_table_gives_a_flat_model(spark):
    flat = train(spark.createDataFrame([], "text string"))
    assert flat.pairs.sum() == 0 and np.isfinite(flat.each("ab")).all()
    assert len(flat.pairs) == encoding.BUCKETS


GERMAN = "Während der Überfahrt hörte die Füchsin große Vögel über den Dächern. Plötzlich öffnete sich die Tür, und süße Klöße standen für alle bereit. "
FRENCH = "Après la tempête, la boîte à gâteaux était déjà vide. « Où êtes-vous passés ? » s’écria la régisseuse, très étonnée. "


def western_model():
    from quillgraph.llm import encoding as E

    pairs, chars = np.zeros(E.BUCKETS, np.int64), np.zeros(E.CHARS, np.int64)
    c = E.codes("\n" + (GERMAN + FRENCH) * 300 + "\n")
    pairs += np.bincount(E.hashed(c), minlength=E.BUCKETS)
    chars += np.bincount(c[:-1], minlength=E.CHARS)
    return E.Model(pairs, chars)


def test_single_letters_between_single_byte_encodings():
    from quillgraph.llm import encoding as E

    model = western_model()
    for seen, true in (("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp850")):
        for text in (GERMAN, FRENCH):
            if (bad := E.garbled(text, seen, true)) is None:
                continue
            restored, used, n = E.restore(bad, model)
            assert n and restored == text, (seen, true, used, restored)
    assert E.restore(GERMAN + "20 °C, 3 ½ Zoll, 5 £, Рынок", model)[2] == 0


def test_clues_for_many_texts_equal_those_for_each():
    from quillgraph.llm import encoding as E

    texts = ["", "plain", "Ã©tÃ©", "GrÃ¼n", "中文", "Gr眉n", "x�y", "â€”", "l’été", GERMAN]
    assert E.suspicions(texts).tolist() == [E.suspicious(t) for t in texts]
    assert not E.suspicious(GERMAN) and not E.suspicious(FRENCH) and E.suspicious("GrÃ¼n")


def test_margin_is_validated():
    from quillgraph.llm import encoding as E

    margin, changed, recall = E.fitted_margin(western_model(), [GERMAN, FRENCH] * 40)
    assert margin == E.MARGINS[0] and changed == 0.0 and recall > 0.6


def test_the_margin_is_validated_on_all_records(spark, tmp_path, monkeypatch):
    """Changed records count wherever they stand in the table, also behind the 300 that were once drawn by this order."""
    from quillgraph.llm import encoding as E

    ids = [r.id for r in spark.range(310).orderBy(F.xxhash64("id", F.lit(9))).collect()]
    texts = [(GERMAN + FRENCH) * 20] * 306 + [E.garbled(GERMAN, seen, true) for seen, true in (("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "mac_roman"))]
    assert not any(map(suspicious, texts[-4:]))
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def found():
        return {r.doc_id: r.restored for r in E.p9_restored(spark, str(tmp_path)).collect()}

    # four of 310 are too many for the first margin, and the next one changes none
    monkeypatch.setattr(E, "MARGINS", (8.0, 1e6))
    assert found() == {}
    # for a greater share they aren't
    monkeypatch.setattr(E, "CHANGED", 4 / 310)
    assert found() == dict.fromkeys(ids[-4:], GERMAN)
