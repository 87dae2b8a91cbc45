from quillgraph.llm.lookalikes import Trie, by_table, odd_tokens, plain_verdict, regularised, skeleton, units

IRREGULAR = {
    "a": "ａｂc", "b": "x y", "c": "Habaha Guеst", "d": "铁​锹", "e": "放⼤镜", "f": "甲‧乙", "g": "café", "h": "机号ΚΒ-5008",
    "i": "А typical day", "j": "\uf929", "k": "word­", "l": "роре said", "m": "𝐀bc", "n": "甲﻿",
}
REGULAR = {
    "1": "Ночной дом", "2": "α 版", "3": "Ω 形态", "4": "φως", "5": "👨‍👩‍👧 ok", "6": "café “x” — y…", "7": "「甲」，乙　丙！", "8": "甲·乙", "9": "舊誰", "0": "❤️", "x": "Привет 5", "y": "\ufa0e",
}
FORMS = {"a": "abc", "b": "x y", "c": "Habaha Guest", "d": "铁锹", "e": "放大镜", "f": "甲·乙", "g": "café", "h": "机号KB-5008", "i": "A typical day", "j": "朗", "k": "word", "l": "pope said", "m": "Abc", "n": "甲"}


def test_trie():
    trie = Trie([("pope", 3), ("pop", 9), ("Kalin", 1), ("铁锹", 2), ("Café", 4), ("pOpe", 90)])
    assert trie.match("роре") == ("pope", "pope")
    assert trie.match("po​p") == ("pop", "pop")
    assert trie.match("Κаlіn") == ("Kalin", "Kalin")
    assert trie.match("铁​锹") == ("铁锹", "铁锹")
    # another case or accent is paid for and stays
    assert trie.match("Роре") == ("pope", "Pope")
    assert trie.match("Сafe") == ("Café", "Cafe")
    assert trie.match("Kolin") is None and trie.match("po") is None and trie.match("РОРΕ") is None


def test_units():
    cut = lambda t: [t[a:b] for a, b in units(t)]
    assert cut("拿着铁​锹走") == ["铁​锹"] and cut("大放⼤镜子") == ["放⼤镜"]
    assert cut("机号ΚΒ-5008") == ["ΚΒ-5008"] and cut("guеst") == ["guеst"] and cut("他说роре好") == ["роре"]
    assert skeleton("Роре") == skeleton("pope") and skeleton("放⼤镜") == "放大镜" and skeleton("cafe\u0301") == skeleton("café")


def test_verdicts():
    assert plain_verdict("Тихая") is False and plain_verdict("роре") is None
    assert plain_verdict("guеst") is True and plain_verdict("α") is False
    assert by_table("﻿Ｘ ⼤") == "X 大"
    assert odd_tokens("plain 文字") == []


def test_frame(spark):
    rows = [("t", k, v, "z") for k, v in {**IRREGULAR, **REGULAR, "w": "the pope speaks"}.items()] + [("t", "q", None, "z"), ("t", "r", "", "z"), ("t", "a", IRREGULAR["a"], "z")]
    frame = spark.createDataFrame(rows, "table_name string, record_id string, text string, token string")
    out = regularised(frame).collect()
    assert {r.record_id: r.regular for r in out} == FORMS
    assert len(out) == len(FORMS)
    assert {r.record_id for r in out if r.walked} == {"g", "l"}
    known = spark.createDataFrame([*rows, *(("v", k, v, "z") for k, v in FORMS.items())], frame.schema)
    assert {r.record_id for r in regularised(known).collect() if r.walked == r.units} >= {"a", "c", "d", "e", "g", "k", "l"}
    assert regularised(frame.limit(0)).count() == 0


def test_without_vocabulary(spark):
    frame = spark.createDataFrame([("t", "1", "роре"), ("t", "2", "x" * 100_000 + "​")], "table_name string, record_id string, text string")
    assert [r.record_id for r in regularised(frame).collect()] == ["2"]
