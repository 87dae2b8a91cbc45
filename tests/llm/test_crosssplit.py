from quillgraph.llm.crosssplit import canonical, overlaps, same_words

ROWS = [
    ("q1", "阿明·川远的武器是什么？", "train", "铁锹", False, "x"),
    ("q2", "请问阿明·川遠之武器是啥", "test", "铁锹", False, "x"),
    ("q3", "阿明·川远的搭档是什么？", "test", "小李", False, "x"),
    ("q4", "巴音·岭霍的武器是什么？", "dev", "铁锹", False, "x"),
    ("q5", "What is the height of Dalin Morvek?", "train", "n/a", True, "x"),
    ("q6", "What is the weight of Dalin Morvek?", "test", "n/a", True, "x"),
    ("q7", "what was the heigth of Dalin Morvek? Thanks!", "dev", "n/a", True, "x"),
    ("q8", None, "test", "铁锹", False, "x"),
    ("q9", "", "train", None, None, "x"),
    ("q10", "阿明·川远的武器是什么？", None, "铁锹", False, "x"),
    ("q11", "孤独的问题？", "test", None, None, "x"),
    ("q12", "孤独的问题", "train", None, None, "x"),
    # one wording is confirmed whatever its answers
    ("q13", "Which lantern hangs above the old harbour gate?", "train", "the copper one", False, "x"),
    ("q14", "which lantern hangs above the old harbour gate", "dev", "copper lantern", False, "x"),
    ("q15", "Which lantern hangs above the old harbuor gate?", "test", "the coper one", False, "x"),
]
SCHEMA = "id string, question string, split string, answer string, open boolean, canon string"


def test_canonical():
    assert canonical("【补录】《書名》中，关于Ａbc那什么？？") == canonical("《书名》里，关于abc的什么？")
    assert canonical("Please tell me: Which cafés?") == "what cafes"


def test_same_words():
    common = {"height", "weight"}.__contains__
    assert same_words("what is the height of x", "what is the heigth of x", False, common)
    assert not same_words("what is the height of x", "what is the weight of x", False, common)
    assert not same_words("体 重", "身 高", False, common)


def test_frame(spark):
    filler = [(f"f{k}", f"What is the {w} of Somebody{k}?", "train", str(k), False, "x") for k in range(600) for w in ["height" if k % 2 else "weight"]]
    frame = spark.createDataFrame(ROWS + filler + ROWS[:2], SCHEMA)
    got = {(r.id_a, r.id_b) for r in overlaps(frame).collect()}
    assert got == {("q1", "q2"), ("q5", "q7"), ("q11", "q12"), ("q13", "q14"), ("q13", "q15")}
    assert overlaps(frame.limit(0)).count() == 0


def test_many_copies(spark):
    rows = [(f"t{k}", "阿明·川远的武器是什么？", "train" if k % 2 else "test", "铁锹", False) for k in range(200)]
    assert overlaps(spark.createDataFrame(rows, "id string, question string, split string, answer string, open boolean")).count() == 100 * 100
