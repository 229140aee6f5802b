from __future__ import annotations

import operator

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecframe.functions import values
from vecframe.functions.filters import BooleanOp, Comparison, FilterSyntaxError, Not, parse, tokenize
from vecframe.functions.predicate import matching

PEOPLE = [
    (0, "alice", 25, 88.5, "new_york"), (1, "bob", 30, 92.0, "boston"), (2, "carol", 25, 75.5, "boston"), (3, "dave", 35, 88.5, "chicago"), (4, "eve", 40, 95.0, "new_york"), (5, "frank", 22, 60.0, "chicago"),
]
HITS = {
    'name != "alice"': {1, 2, 3, 4, 5}, "age > 30": {3, 4}, "age < 25": {5}, "score >= 88.5": {0, 1, 3, 4}, "score <= 75.5": {2, 5}, 'age > 24 AND city = "boston"': {1, 2}, 'NOT city = "chicago"': {0, 1, 2, 4},
    '(city = "new_york" OR city = "boston") AND age > 26': {1, 4}, 'age >= 30 AND name = "bob"': {1}, "age = 25": {0, 2}, "age != 25": {1, 3, 4, 5}, "score > 88.5": {1, 4}, "age >= 0": {0, 1, 2, 3, 4, 5}, "age > 100": set(),
}


def test_tokens_and_trees():
    assert [t.kind for t in tokenize('age = 30 AND name = "Alice"', strict=True)] == ["name", "cmp", "long", "bool", "name", "cmp", "string"]
    assert len(tokenize('(age = 30 OR age = 31) AND name = "Alice"', strict=True)) == 13
    for strict in (True, False):
        tree = parse('(age = 30 OR age = 31) AND name = "Alice"', strict)
        assert tree == BooleanOp("AND", BooleanOp("OR", Comparison("age", "=", 30), Comparison("age", "=", 31)), Comparison("name", "=", "Alice"))
        assert parse("NOT age = 30", strict) == Not(Comparison("age", "=", 30))
        assert parse("a = 1 OR b = 2 AND c = 3", strict) == BooleanOp("AND", BooleanOp("OR", Comparison("a", "=", 1), Comparison("b", "=", 2)), Comparison("c", "=", 3))
        assert parse("x_1 >= 007", strict) == Comparison("x_1", ">=", 7)
        assert parse("a = 1 AND", strict) == BooleanOp("AND", Comparison("a", "=", 1), None)
        assert parse("  ", strict) is None


@pytest.mark.parametrize("text", ["a == 1", "a <> 1", "name = 'x'", "a.b = 1", "a = 1 and b = 2", "a = 1 NOT b = 2", "123 = 1", '"a" = 1', "AND a = 1", "()", "a", "a =", "(a = 1", "a = b", "a = 1e3", "a = true", "a = 99999999999999999999"])
def test_rejected(text):
    for strict in (True, False):
        with pytest.raises(FilterSyntaxError):
            parse(text, strict)


@pytest.mark.parametrize("text", ["NOT (a = 1)", "((a = 1 OR b = 2) AND c = 3)", "( a = 1 )", "a=1", "a > -5", 'name = "John Doe"', 'name = "a(b"'])
def test_extensions(text):
    assert parse(text) is not None
    with pytest.raises(FilterSyntaxError):
        parse(text, strict=True)


def test_people(spark):
    df = spark.createDataFrame(PEOPLE, "doc_id long, name string, age long, score double, city string")
    for text, hits in HITS.items():
        assert {r.doc_id for r in matching(df, text).collect()} == hits, text


FIELDS = st.sampled_from(["a", "b", "c"])
VALUES = st.one_of(st.integers(-3, 3), st.sampled_from([-1.5, 0.0, 1.0, 2.5]), st.sampled_from(["", "1", "x"]))
TREES = st.recursive(st.builds(Comparison, FIELDS, st.sampled_from(["=", "!=", ">", "<", ">=", "<="]), VALUES), lambda t: st.one_of(st.builds(Not, t), st.builds(BooleanOp, st.sampled_from(["AND", "OR"]), t, t)), max_leaves=4)
RECORDS = [(i, dict(r)) for i, r in enumerate([{}, {"a": 1}, {"a": 1.0, "b": "x"}, {"a": "1", "b": 2}, {"b": -2, "c": 2.5}, {"a": -3, "b": -1.5, "c": ""}])]
OPS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def evaluate(tree, record) -> bool:
    if isinstance(tree, Not):
        return not evaluate(tree.child, record)
    if isinstance(tree, BooleanOp):
        left, right = evaluate(tree.left, record), evaluate(tree.right, record)
        return left and right if tree.op == "AND" else left or right
    if tree.field not in record:
        return False
    a, b = record[tree.field], tree.value
    return OPS[tree.op]((values.rank_of(a), a) if values.rank_of(a) == values.rank_of(b) else (values.rank_of(a), 0), (values.rank_of(b), b) if values.rank_of(a) == values.rank_of(b) else (values.rank_of(b), 0))


@settings(max_examples=25, deadline=None)
@given(TREES)
def test_trees_against_plain_evaluation(spark, tree):
    from vecframe.functions.predicate import compile_tree, map_leaf

    df = spark.createDataFrame([(i, {k: values.tagged(v) for k, v in r.items()}) for i, r in RECORDS], "doc_id long, metadata map<string,struct<k:tinyint,l:bigint,d:double,s:string>>")
    found = {r.doc_id for r in df.where(compile_tree(tree, map_leaf())).collect()}
    assert found == {i for i, r in RECORDS if evaluate(tree, r)}
