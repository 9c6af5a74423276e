import random

import pytest
from pyspark.sql import functions as F

from rillstone.plans import filter_lang as L
from rillstone.plans.query import FlowQuery

FLOW = [(0x0A000001, 0x0A000002, 1, 1234, 80, 6, 5000, 4, 1, 100, 100, 256, "tcp-web")]
COLUMNS = "src long, dst long, flow_id long, sport long, dport long, proto long, octets long, packets long, records long, first_ms long, last_ms long, template_id long, name string"


@pytest.fixture(scope="module")
def flow(spark):
    return spark.createDataFrame(FLOW, COLUMNS)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("octets > 1000 and proto == 6", True),
        ("proto == 17", False),
        ("proto in [6, 17]", True),
        ("proto in [17, 'x']", False),
        ("not proto == 17", True),
        ("! proto = 6", False),
        ("missing == 1", False),
        ("missing != 1", False),
        ("not missing == 1", True),
        ("name contains 'web'", True),
        ("name contains ''", True),
        ('name == "tcp-web"', True),
        ("octets == 0x1388", True),
        ("octets < 18446744073709551615", True),
        ("octets contains '\x13'", True),
        ("name > 5", True),
        ("template == 256 or missing == 1 and octets < 1", True),
        ("not (octets > 1 and not (proto == 6))", True),
    ],
)
def test_evaluates(flow, text, expected):
    columns = L.flow_columns(flow) | {"name": flow["name"]}
    assert [r[0] for r in flow.select(L.compile_filter(text, flow, columns)).collect()] == [expected]


@pytest.mark.parametrize("text", ["", "and or", "octets >", "a b", "x in []", "x in [1,]", "(a == 1", "a == 1)", "x contains 5", "x And y", "a == -1", "a == 1.5", "a == 18446744073709551616", "min(a, 2) == 1"])
def test_refuses(text):
    with pytest.raises(L.FilterError):
        L.parse(text)


def test_shape_and_limits():
    assert isinstance(L.parse("a == 1 and b == 2 or c == 3"), L.Or) and L.cost("a == 1 and b == 2 or c == 3") == 3
    assert L.parse("not not a == 1") == L.Compare("a", "==", 1)
    with pytest.raises(L.FilterError):
        L.tokenize("a " * 4097)
    L.tokenize("a " * 4096)
    assert L.depth(L.parse(" or ".join(["a == 1"] * 200))) == 2
    assert L.depth(L.parse(" or ".join(["a == 1"] * 200)), binary=True) == 200


def test_long_chains(flow):
    text = " or ".join(["octets == 1"] * 300 + ["proto == 6"])
    assert flow.where(L.compile_filter(text, flow, L.flow_columns(flow))).count() == 1
    assert flow.where(L.compile_filter(text, flow, L.flow_columns(flow), compat=True)).count() == 0
    deep = "(" * 1 + "not (" * 200 + "proto == 6" + ")" * 200 + ")"
    with pytest.raises(L.FilterError):
        L.compile_filter(deep, flow, L.flow_columns(flow))


def test_random_trees_match_two_valued_logic(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(4)]), rng.choice([None, *range(4)])) for _ in range(60)]
    df = spark.createDataFrame(rows, "a long, b long")

    def tree(depth):
        if not depth or rng.random() < 0.2:
            field, op, n = rng.choice("abz"), rng.choice(["==", "!=", "<", ">="]), rng.randrange(4)
            f = L.COMPARE[op]
            return f"{field} {op} {n}", lambda r: (v := {"a": r[0], "b": r[1]}.get(field)) is not None and f(v, n)
        kind = rng.choice(["and", "or", "not"])
        x, fx = tree(depth - 1)
        if kind == "not":
            return f"not ({x})", lambda r: not fx(r)
        y, fy = tree(depth - 1)
        return f"({x}) {kind} ({y})", (lambda r: fx(r) and fy(r)) if kind == "and" else (lambda r: fx(r) or fy(r))

    trees = [tree(4) for _ in range(25)]
    found = df.select(*[L.compile_filter(t, df, value=True).alias(f"t{i}") for i, (t, _) in enumerate(trees)]).collect()
    for i, (t, f) in enumerate(trees):
        assert [r[i] for r in found] == [bool(f(r)) for r in rows], t


def test_pushdown(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = df.where(L.compile_filter("o_orderkey > 100 and not not o_custkey == 7", df))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,100)" in plan and "EqualTo(o_custkey,7)" in plan


def test_query_builder(spark):
    rows = [(0, 0, i, 0, 0, 6, o, 1, 1, 0, 100, i) for i, o in ((1, 50), (2, 500), (3, 150))]
    df = spark.createDataFrame(rows, "src long, dst long, flow_id long, sport long, dport long, proto long, octets long, packets long, records long, first_ms long, last_ms long, ord long")
    result = FlowQuery().where("octets >= 100").order_by("octets", True).limit(1).aggregate("count", "sum_octets").run(df)
    assert [r.flow_id for r in result.rows.collect()] == [2]
    assert tuple(result.counts.first()) == (3, 2) and tuple(result.aggregates.first()) == (2, 650)
    ties = FlowQuery().order_by("records", True).run(df).rows
    assert [r.flow_id for r in ties.collect()] == [3, 2, 1]
    assert [r.flow_id for r in FlowQuery().order_by("records").run(df).rows.collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        FlowQuery().aggregate("median")
    with pytest.raises(ValueError):
        FlowQuery().order_by("colour").run(df).rows.collect()
    assert df.where(F.lit(False)).count() == 0
