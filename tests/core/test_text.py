import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def one(spark, expr, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*(F.col(n) for n in names)).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("你", ["你"]), ("你好", ["你好"]), ("一二三四五", ["一二", "二三", "三四", "四五"]), ("AP717", ["ap", "717"]), ("0.75", ["0.75"]), ("", []), ("b c你好b", ["你好", "b", "c", "b"]), ("héros", ["h", "ros"])],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens, text) == want


@pytest.mark.parametrize(
    "a, b, want",
    [("阿·明", "阿明", "strong"), ("阿明（2）", "阿明", "incompatible"), ("阿明（２）", "阿明(2)", "weak"), ("阿明远", "阿明川", "weak"), ("阿明", "川明", "incompatible"), ("Amin", "阿明", "incompatible"), ("·", "阿明", "incompatible")],
)
def test_verdict(spark, a, b, want):
    assert one(spark, T.lexical_verdict, a, b) == want


def test_names_and_marks(spark):
    assert one(spark, T.normal_name, " 　Ab（1）·“C” ") == "ab1c"
    assert one(spark, T.script, "A阿") == "mixed" and one(spark, T.script, "12") == "ascii"
    assert one(spark, T.without_space, "a　b\n c") == "abc"
    assert one(spark, T.without_citations, "见doc-0001和[12]") == "见和"
    assert one(spark, T.refuses, "资料中未提及。") and not one(spark, T.refuses, "x" * 160 + "未提及")


def test_windows_and_occurrences(spark):
    assert one(spark, lambda c: T.windows(c, 2), "abcd") == ["ab", "bc", "cd"] and one(spark, lambda c: T.windows(c, 2), "a") == ["a"]
    assert one(spark, T.occurrences, "aaaa", "aa") == 2 and one(spark, T.occurrences, "a.b.", ".") == 2 and one(spark, T.occurrences, "a", "") == 0
