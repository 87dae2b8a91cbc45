import random

import pytest

from quillgraph.llm import grouping
from quillgraph.llm.grouping import components, grouped


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            up[find(a)] = find(b)
    return {x: find(x) for x in up}


def same_partition(got, want):
    groups = lambda m: {frozenset(x for x in m if m[x] == g) for g in m.values()}
    return groups(got) == groups(want)


@pytest.mark.parametrize("rounds", [1, 3])
def test_random_graphs(spark, rounds):
    r = random.Random(rounds)
    pairs = [(f"v{r.randrange(120)}", f"v{r.randrange(120)}") for _ in range(80)] + [(f"c{k}", f"c{k + 1}") for k in range(25)] + [("hub", f"h{k}") for k in range(60)] + [(None, "x"), ("s", "s"), ("c1", "c0")]
    got = {x.vertex: x.component for x in components(spark.createDataFrame(pairs, "a string, b string"), rounds).collect()}
    assert same_partition(got, union_find(pairs))


def test_grouped(spark):
    records = [("E3", ["甲", "", None, "乙"]), ("E1", ["甲"]), ("E2", ["丁"]), ("E4", ["戊"]), ("E5", []), ("E6", None), ("E3", ["甲"]), ("E7", ["丁", "丁"]), (None, ["甲"])]
    links = [("乙", "丙"), ("丙", "丁"), ("戊", ""), (None, "戊"), ("戊", "己")]
    frame = spark.createDataFrame(records, "id string, names array<string>")
    out = grouped(frame, spark.createDataFrame(links, "a string, b string")).collect()
    assert sorted((r.entity_id, r.group_id) for r in out) == [(x, "E1") for x in ("E1", "E2", "E3", "E7")]
    assert grouped(frame.limit(0), spark.createDataFrame(links, "a string, b string")).count() == 0


@pytest.mark.parametrize("few", [1, 60, 1 << 10])
def test_few_edges_are_joined_in_one_task(spark, monkeypatch, few):
    """However the levels end, the components are whole; few edges make one table of clusters."""
    r = random.Random(few)
    pairs = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(40)] + [(None, 5), (7, 7), (1001, 1000)]
    labels, own = [], grouping.written

    def counted(df, label="stage"):
        labels.append(label)
        return own(df, label)

    monkeypatch.setattr(grouping, "written", counted)
    for kind in ("long", "string"):
        got = {x.vertex: x.component for x in components(spark.createDataFrame(pairs, "a long, b long").selectExpr(f"cast(a AS {kind}) a", f"cast(b AS {kind}) b"), few=few).collect()}
        assert {int(v) for v in got} == set(union_find(pairs)) and same_partition({int(v): int(c) for v, c in got.items()}, union_find(pairs))
    assert few < 1 << 10 or labels.count("clusters") == 2
