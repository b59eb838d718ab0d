import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querymill.functions import equality as EQ
from querymill.functions import text as TX


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("word,expected", [("cities", "city"), ("boxes", "box"), ("cats", "cat"), ("ties", "ti"), ("es", "es"), ("gas", "gas"), ("", "")])
def test_stem(spark, word, expected):
    assert one(spark, TX.stem, word) == expected


def test_tokens(spark):
    assert one(spark, TX.retrieval_tokens, "How many Cities_x are in the 12 boxes, a b? ORDER BY") == ["how", "many", "cities_x", "are", "the", "12", "box"]
    assert one(spark, TX.retrieval_tokens, None) == []


def test_sql_text(spark):
    sql = "SELECT a, b -- note\nFROM t /* x\ny */ WHERE c = ' P '  GROUP BY a, b ORDER BY a ;"
    normal = one(spark, TX.normal_sql, sql)
    assert normal == "select a, b from t where c = ' p ' group by a, b order by a ;"
    assert one(spark, TX.field_list, normal) == "a, b" and one(spark, TX.group_fields, normal) == "a, b"
    assert one(spark, TX.sql_key, " SELECT  1 ; ;") == one(spark, TX.sql_key, "select 1") == "select 1"
    assert one(spark, TX.string_literals, "x = ' P ' AND y = \"q\" OR z = 'P'") == ["P", "q"]
    assert one(spark, TX.has_spaced_literal, "x = 'a '") and not one(spark, TX.has_spaced_literal, "x = 'a'")


def test_answers(spark):
    assert one(spark, TX.clean_answer, '```json\n{"sqls": ["SELECT a\\nFROM t;", "SELECT b"]}\n```') == "SELECT a FROM t"
    assert one(spark, TX.clean_answer, "Here it is:\n```sql\nWITH x AS (SELECT 1) SELECT * FROM x; -- done\n```") == "WITH x AS (SELECT 1) SELECT * FROM x"
    assert one(spark, TX.clean_answer, "no statement") is None and one(spark, TX.clean_answer, None) is None
    assert one(spark, TX.answer_statements, 'text {"sqls": ["a", "b", "a", " "]} more') == ["a", "b"]
    assert one(spark, TX.answer_statements, "none") == []


def test_small_texts(spark):
    assert one(spark, TX.normal_question, "What’s  the NAME?!") == "what's the name"
    assert one(spark, lambda c: TX.shorten(c, 5), "abcd efgh") == "abcd ..." and one(spark, lambda c: TX.shorten(c, 9), "abcd efgh") == "abcd efgh"
    assert one(spark, TX.identifier_words, "homeDock_idX a") == ["home", "dock", "id"]
    assert one(spark, TX.plural_forms, ["cities", "boxes", "cats"], "array<string>") == ["cities", "boxes", "cats", "city", "box", "cat"]
    assert one(spark, TX.safe_name, "a-b c") == "a_b_c"


CASES = [
    ('[[1,"a"],[2,"b"]]', '[[2,"b"],[1,"a"]]', True, True), ("[[1,2]]", "[[2,1]]", False, False), ("[[1]]", "[[1.0]]", False, False),
    ("[[null]]", '[["None"]]', True, False), ("[]", None, False, False), ("[[1],[1]]", "[[1]]", False, False), ("[[1]]", '[["1"]]', True, False),
]


@pytest.mark.parametrize("a,b,same,same_typed", CASES)
def test_equality(spark, a, b, same, same_typed):
    assert (one(spark, EQ.result_key, a) == one(spark, EQ.result_key, b)) is same
    assert (one(spark, EQ.typed_key, a) == one(spark, EQ.typed_key, b)) is same_typed


def test_missing_and_order(spark):
    assert one(spark, EQ.result_key, None) == "NULL_RESULT" and one(spark, EQ.result_key, "[]") == "[]"
    assert one(spark, EQ.ordered_key, None) is None
    assert one(spark, EQ.ordered_key, "[[1],[2]]") != one(spark, EQ.ordered_key, "[[2],[1]]")
    assert one(spark, EQ.shape, "[[1,2],[3,4]]").asDict() == {"rows": 2, "cols": 2, "empty": False, "scalar": False}
    assert one(spark, EQ.shape, "[[1]]").scalar and one(spark, EQ.shape, None) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(-9, 9), st.text("abc ", max_size=3), st.none()), min_size=2, max_size=2), max_size=5), st.randoms())
def test_row_order_never_counts(spark, rows, rnd):
    other = list(rows)
    rnd.shuffle(other)
    keys = spark.createDataFrame([(json.dumps(rows),), (json.dumps(other),)], "x string").select(EQ.result_key(F.col("x")).alias("k")).collect()
    assert keys[0].k == keys[1].k
