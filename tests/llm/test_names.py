import pytest
from pyspark.sql import functions as F

from quillgraph.llm.names import Tables, folded, learn, near, parse, same_entities, show_of, stored, within_radius

GIVEN = dict(zip("阿巴卡达法加哈罗米诺帕萨", ["a", "ba", "ka", "da", "fa", "jia", "ha", "luo", "mi", "nuo", "pa", "sa"], strict=True))
FAMILY = dict(zip("川冬枫海江林宁桥山松田云", ["chuan", "dong", "feng", "hai", "jiang", "lin", "ning", "qiao", "shan", "song", "tian", "yun"], strict=True))


def names(n=40):
    g, f = list(GIVEN), list(FAMILY)
    out = []
    for k in range(n):
        a, b = [g[(k + 5 * j) % 12] for j in range(3)], [f[(k * 7 + 3 * j + k // 12) % 12] for j in range(3)]
        out.append(("".join(a) + "·" + "".join(b), ("".join(GIVEN[c] for c in a).capitalize() + " " + "".join(FAMILY[c] for c in b).capitalize())))
    return out


@pytest.fixture(scope="module")
def tables():
    return learn([(a, [b]) for a, b in names(60)])


def test_syllables_are_learnt(tables):
    assert tables.syllables == GIVEN | FAMILY


def test_near():
    assert near("abc", "abc") and near("abc", "acb") and near("abc", "ab") and near("abc", "abxc") and near("abc", "axc")
    assert not near("abc", "cab") and not near("abc", "a") and not near("ab", "ba1")


@pytest.mark.parametrize(
    "spelling, want",
    [
        ("阿巴卡·川冬枫", ("chinese", "person", "", "阿巴卡", "川冬枫")), ("川冬枫，阿巴卡", ("chinese", "person", "", "阿巴卡", "川冬枫")), ("老阿巴卡·川冬枫先生（旧译）", ("chinese", "person", "", "阿巴卡", "川冬枫")),
        ("阿巴卡·川冬枫二世", ("chinese", "person", "2", "阿巴卡", "川冬枫")), ("阿巴卡·川冬枫（2）", ("chinese", "person", "2", "阿巴卡", "川冬枫")), ("阿.川冬枫", ("initial", "person", "", "阿", "川冬枫")),
        ("阿卡（川冬枫家）", ("nick", "person", "", "卡", "川冬枫")), ("川冬枫家的巴卡", ("nick", "person", "", "巴卡", "川冬枫")), ("阿巴卡川冬枫合唱队", ("chinese", "choir", "", "阿巴卡", "川冬枫")),
        ("林场“川冬枫阿巴卡”", ("chinese", "forestry", "", "阿巴卡", "川冬枫")), ("Abaka Chuandongfeng Choir", ("latin", "choir", "", "abaka", "chuandongfeng")), ("Chuandongfeng, Abáka", ("latin", "person", "", "abaka", "chuandongfeng")),
        ("Captain Abaka Chuandongfeng Jr.", ("latin", "person", "jr", "abaka", "chuandongfeng")), ("Aba. Chuandongfeng", ("initial", "person", "", "aba", "chuandongfeng")), ("巴巴·川冬枫", ("nick", "person", "", "巴", "川冬枫")), ("巴卡·川冬枫", ("nick", "person", "", "巴卡", "川冬枫")),
        ("阿巴卡/川冬渡", ("chinese", "person", "", "阿巴卡", "川冬渡")), ("川冬枫-阿巴卡渡", ("chinese", "ferry", "", "阿巴卡", "川冬枫")), ("阿巴川冬林场", ("clipped", "forestry", "", "川冬", "阿巴")),
    ],
)
def test_parse(tables, spelling, want):
    assert parse(spelling, tables) == want


def test_shows():
    shows = {folded(n).lower(): "S1" for n in ("星河谷物语", "Starriver Vale Tales")} | {"星河站物语": "S2"}
    assert [show_of(x, shows) for x in ("动画片星河谷物语", "物语·星河谷", "星河谷之物语", "Starriver Vale Tlaes", "星河谷物")] == ["S1"] * 5
    assert show_of("星河物语", shows) is None and show_of("星河谷物语二代", shows) is None


def test_frame(spark):
    people = names(40)
    records = [(f"E{k:03d}", a, [b]) for k, (a, b) in enumerate(people)]
    a, b = people[0]
    typo = a[0] + a[1] + "瞳" + a[3:]
    records += [("F1", typo, None), ("F2", b, []), ("F3", a + "（2）", [""]), ("F4", None, [a]), ("F5", "", None), ("F1", typo, None), ("F6", a + "纪念馆", None)]
    ends = [("T1:s", a), ("T2:s", "老" + a), ("T3:o", b), ("T4:s", "完全无关的一句话"), ("T5:s", None), ("T6:o", "动画片星河谷物语"), ("T7:o", "星河谷物语"), ("T2:s", "老" + a)]
    frames = (
        spark.createDataFrame(records, "id string, name string, aliases array<string>").selectExpr("*", "1 AS entity", "2 AS key"),
        spark.createDataFrame(ends, "key string, name string"),
        spark.createDataFrame([("S1", "星河谷物语", ["Starriver Vale Tales"])], "id string, name string, aliases array<string>"),
    )
    out = [tuple(r) for r in same_entities(*frames).collect()]
    same = ["E000", "F1", "F2"]
    want = {(x, y) for x in same for y in same if x < y} | {(x, "T2:s") for x in same} | {("S1", "T6:o")}
    assert set(out) == want and len(out) == len(want)
    assert same_entities(frames[0].limit(0), frames[1].limit(0), frames[2]).count() == 0


def test_nothing_learnt():
    t = learn([])
    assert isinstance(t, Tables) and parse("某某某·某某某", t)[0] == "chinese"


def test_an_alias_decides_between_two_of_a_family(spark):
    """An initial that two people fit, and its own alias names one of them; an alias of someone else is not followed."""
    people = names(40)
    records = [(f"E{k:03d}", a, [b]) for k, (a, b) in enumerate(people)]
    house, latin = "川冬枫", "Chuandongfeng"
    records += [("A1", "阿巴卡·" + house, None), ("A2", "阿达法·" + house, None), ("B1", "阿·" + house, ["Abaka " + latin]), ("B2", "阿." + house, ["阿达法·" + house, people[3][1]]), ("B3", "阿-" + house, [people[5][0]])]
    records += [("C1", "阿_" + house, ["阿巴卡·" + house]), ("C2", "阿_" + house, ["阿达法·" + house])]
    frames = (
        spark.createDataFrame(records, "id string, name string, aliases array<string>"),
        spark.createDataFrame([], "key string, name string"),
        spark.createDataFrame([], "id string, name string, aliases array<string>"),
    )
    out = {tuple(r) for r in same_entities(*frames).collect()}
    assert {p for p in out if {"B1", "B2", "B3", "C1", "C2"} & set(p)} == {("A1", "B1"), ("A2", "B2"), ("A1", "C1"), ("A2", "C2"), ("B1", "C1"), ("B2", "C2")}


def test_swapped_syllables_and_other_names(spark):
    people = names(30)
    records = [(f"R{k}", a, [b]) for k, (a, b) in enumerate(people)]
    given, family = people[4][0].split("·")
    moved = given[1] + given[0] + given[2]
    latin = ("".join(GIVEN[c] for c in moved).capitalize() + " " + "".join(FAMILY[c] for c in family).capitalize())
    records += [("W", latin, None)]
    foreign = ["John Michael Smithson", "Smithson, John Michael", "Jon Michael Smithson", "María García López", "Maria Garcia Lopes", "Иван Петрович Сидоров", "Сидоров Иван Петровч", "李明", "李明", "王明"]
    records += [(f"F{k}", n, None) for k, n in enumerate(foreign)]
    frames = (
        spark.createDataFrame(records, "id string, name string, aliases array<string>"),
        spark.createDataFrame([], "key string, name string"),
        spark.createDataFrame([], "id string, name string, aliases array<string>"),
    )
    out = {tuple(r) for r in same_entities(*frames).collect()}
    want = {("F0", "F1"), ("F0", "F2"), ("F1", "F2"), ("F3", "F4"), ("F5", "F6"), ("F7", "F8")}
    assert {p for p in out if p[0][0] == "F"} == want
    assert {p for p in out if "W" in p} == {("R4", "W")}


def test_leads_are_followed_to_their_end(spark):
    from quillgraph.llm.names import followed

    rows = [("c", "abcdef", 9), ("c", "abcdeg", 5), ("c", "abcdhg", 2), ("c", "zzzzzz", 1), ("d", "abcdeg", 1)]
    out = {(r.cell, r.text): r.lead for r in followed(spark.createDataFrame(rows, "cell string, text string, weight long")).collect()}
    assert out == {("c", "abcdef"): "abcdef", ("c", "abcdeg"): "abcdef", ("c", "abcdhg"): "abcdef", ("c", "zzzzzz"): "zzzzzz", ("d", "abcdeg"): "abcdeg"}


def test_records_stay_off_the_driver(spark, monkeypatch):
    """What teaches the tables is collected by character, not by record."""
    from quillgraph.llm import names as module

    class Learnt(Exception):
        pass

    def stop(spellings, tables, listed):
        raise Learnt

    records = spark.createDataFrame([(f"E{k}", a, [b]) for k, (a, b) in enumerate(names(60) * 20)], "id string, name string, aliases array<string>")
    kind, sizes = type(records), []
    collect = kind.collect

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(kind, "collect", counted)
    monkeypatch.setattr(module, "entities_of", stop)
    with pytest.raises(Learnt):
        same_entities(records, spark.createDataFrame([], "key string, name string"), records.limit(0))
    assert sizes and max(sizes) <= len(GIVEN) + len(FAMILY)


def test_all_records_teach_the_tables(spark):
    """A character that stands only behind 20,100 other records, in the order in which a bounded number was once drawn, is learnt."""
    people = names(60)
    *first, last = (r.id for r in spark.range(61).selectExpr("'E' || id AS id").orderBy(F.xxhash64("id")).collect())
    rows = [(i, a, [b]) for i, (a, b) in zip(first, people, strict=True)] * 335 + [(last, "珂巴卡·川冬枫", ["Kebaka Chuandongfeng"])] * 3
    records = spark.createDataFrame([*rows, ("x", None, ["Abaka"]), ("y", "Kebaka Chuandongfeng", None)], "id string, name string, aliases array<string>")
    out = {tuple(r) for r in same_entities(records, spark.createDataFrame([], "key string, name string"), records.limit(0)).collect()}
    assert out == {(last, "y")}

    from quillgraph.llm.names import learnt

    found, want = learnt(records), learn([r[1:] for r in rows])
    assert found.syllables == want.syllables == GIVEN | FAMILY | {"珂": "ke"} and found.given == want.given
    nothing = learnt(records.limit(0))
    assert nothing.syllables == nothing.given == {}


def test_records_without_aliases_and_ends_teach_the_positions(spark):
    """A name without a separator, family part first, is read by what records without aliases, or triple ends alone, show."""
    people = [a for a, _ in names(40)]
    given, family = people[0].split("·")
    turned = ("W", family + given, [])
    kinds = "id string, name string, aliases array<string>"
    none = spark.createDataFrame([], kinds)

    def found(records, ends):
        return {tuple(r) for r in same_entities(spark.createDataFrame(records, kinds), spark.createDataFrame(ends, "key string, name string"), none).collect()}

    assert found([turned, *((f"E{k:03d}", a, [None, []][k % 2]) for k, a in enumerate(people))], []) == {("E000", "W")}
    assert found([turned], [(f"T{k}:s", a) for k, a in enumerate(people)] * 2) == {("T0:s", "W")}


def test_records_without_a_name_teach_the_tables(spark):
    from quillgraph.llm.names import learnt

    rows = [([None, ""][k % 2], [a, b]) for k, (a, b) in enumerate(names(60))] + [("珂巴卡·川冬枫", None), ("珂巴卡·川冬枫", None), (None, None)]
    found, want = learnt(spark.createDataFrame(rows, "name string, aliases array<string>")), learn(rows)
    assert found.syllables == want.syllables == GIVEN | FAMILY and found.given == want.given and found.given["珂"] > 0.8


def test_exploded_and_stored_names_are_not_broadcast(spark):
    """Files of 10 kB count as small, whatever is exploded from them."""
    nodes = spark.range(400).selectExpr("'person/' AS cell", "concat('name ', lpad(id, 6, '0')) AS text", "id AS weight")
    stored(nodes, "test").write.mode("overwrite").saveAsTable("names_test")
    plain = spark.table("names_test")
    for df in (within_radius(plain), stored(nodes, "test").join(plain, ["cell", "text"])):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString() and df.count()
    spark.sql("DROP TABLE names_test")
