"""Parsers and text functions against values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import extract


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("given, want", [("<Song Jiang>", "Song Jiang"), ("&lt;b&gt;&amp;quot;", "b"), (' "a"\x07 ', "a"), ("　x　", "x"), ("< x >", " x "), ("", ""), (None, None)])
def test_clean_str(spark, given, want):
    assert one(spark, given, T.clean_str) == want


@pytest.mark.parametrize("given, want", [(" 8.5abc", 8.5), ("8 of 10", 8.0), ("high", None), ("", None), ("-.5e1x", -5.0), ("1.", 1.0)])
def test_parse_float(spark, given, want):
    assert one(spark, given, T.parse_float) == want


def test_split_markers(spark):
    assert one(spark, "a;;b, c ,", lambda c: T.split_markers(c, ";", ",")) == ["a", "b", "c"]
    assert one(spark, "a;b", T.split_markers) == ["a;b"]


RECORDS = [
    ('("entity"<|>Song Jiang<|>person<|>leader)', ("SONG JIANG", "PERSON", "leader")),
    ('("entity"<|><Song Jiang><|>person<|>x)', ("SONG JIANG", "PERSON", "x")),
    ('("Entity"<|>A<|>person<|>x)', None),
    ('("entity"<|>A<|>planet<|>x)', None),
    ("no parentheses", None),
    ('("entity"<|>A<|>person<|>x)<|COMPLETE|>', None),
]


@pytest.mark.parametrize("record, want", RECORDS)
def test_entities(spark, record, want):
    rows = extract.record_rows(spark.createDataFrame([(1, 0, record)], "doc_id long, chunk_seq int, response string"))
    got = [(r.entity_name, r.entity_type, r.description) for r in extract.entity_mentions(rows).collect()]
    assert got == ([want] if want else [])


@pytest.mark.parametrize("record, want", [
    ('("relationship"<|>B<|>A<|>d<|>k<|>0.8)', ("A", "B", 0.8, "k")),
    ('("relationship"<|>B<|>A<|>d<|>0.8)', ("A", "B", 0.8, "0.8")),
    ('("relationship"<|>B<|>A<|>d<|>k<|>8 of 10)', ("A", "B", 8.0, "k")),
    ('("relationship"<|>B<|>A<|>d<|>k<|>high)', ("A", "B", 1.0, "k")),
    ('("relationship"<|>B<|>A<|>d)', None),
])
def test_relations(spark, record, want):
    rows = extract.record_rows(spark.createDataFrame([(1, 0, record)], "doc_id long, chunk_seq int, response string"))
    got = [(r.src_id, r.tgt_id, r.weight, r.keywords) for r in extract.relation_mentions(rows).collect()]
    assert got == ([want] if want else [])


def mentions(spark, rows):
    return spark.createDataFrame([(1, 0, i, "N", t, d, "1") for i, (t, d) in enumerate(rows)], "doc_id long, chunk_seq int, rec_seq int, entity_name string, entity_type string, description string, source_id string")


def test_node_merge_ties_go_to_the_later_type(spark):
    assert extract.merged_nodes(mentions(spark, [("P", "a"), ("P", "b"), ("L", "a")])).first().entity_type == "P"
    row = extract.merged_nodes(mentions(spark, [("P", "a"), ("L", "b"), ("L", "c"), ("P", "a")])).first()
    assert (row.entity_type, row.description) == ("L", "a <SEP> b <SEP> c")


def test_thirteen_descriptions_are_to_summarise(spark):
    for n, flagged in ((12, 0), (13, 1)):
        nodes = extract.merged_nodes(mentions(spark, [("P", f"d{i}") for i in range(n)]))
        assert extract.to_summarise(nodes).count() == flagged


def test_search_terms(spark):
    assert one(spark, "Ab, 宋江!", T.normalized) == "ab 宋江"
    assert one(spark, "ab 宋江", lambda c: T.grams(c, 2)) == ["ab", "宋江"]
    assert one(spark, "ab 宋江", lambda c: T.grams(c, 3)) == ["b 宋"]
    assert one(spark, "ab 宋江", T.keywords) == ["ab", "宋江", "宋", "江"]
    assert one(spark, "a", lambda c: T.grams(c, 2)) == []


@pytest.mark.parametrize("a, b, want", [("kitten", "sitting", True), ("AB", "BA", True), ("ABCD", "WXYZ", False), ("TV", "TELEVISION", False)])
def test_similar_names(spark, a, b, want):
    assert one(spark, a, lambda c: T.similar_names(c, F.lit(b))) is want


def test_decisions(spark):
    said = "(For question <|>1<|>, <|>yes<|>)##(For question <|>2<|>, <|>no<|>)##(<|>0<|>,<|>yes<|>)##(<|>9<|>,<|>Yes<|>)"
    assert one(spark, said, lambda c: T.decisions(c, 3)) == [1]


GOOD = '{"title": "t", "summary": "s", "rating": 7, "rating_explanation": "r", "findings": [{"summary": "a", "explanation": "b"},]}'


@pytest.mark.parametrize("given, ok", [
    (GOOD, True), (f"```json\n{GOOD}\n```", True), (f"Sure! {GOOD}", True), (GOOD.replace("7", "11"), False),
    (GOOD.replace('"t"', '""'), False), (GOOD.replace('{"summary": "a", "explanation": "b"},', ""), False), (GOOD[:60], False), (None, False),
])
def test_reports(spark, given, ok):
    assert (one(spark, given, T.report) is not None) is ok


def test_answer(spark):
    said = 'Because [1] it is.\n["A", "B"]'
    assert one(spark, said, T.answer_text) == "Because [1] it is."
    assert one(spark, said, T.answer_entities) == ["A", "B"]
    assert one(spark, 'x ["A", ]', T.answer_entities) == []
    assert one(spark, "no list", T.answer_text) == "no list"


def test_no_similar_names_are_ruled_out(spark):
    draw = random.Random(4)
    names = [("".join(draw.choice("abcdeABÄß 中") for _ in range(draw.randrange(9))), "".join(draw.choice("abcdeABÄß 中") for _ in range(draw.randrange(9)))) for _ in range(3000)]
    rows = spark.createDataFrame(names, "a string, b string")
    told = lambda c: {"length": F.length(c), "size": F.size(T.characters(c)), "mask": T.character_mask(c)}
    got = rows.select(T.similar_names("a", "b").alias("s"), T.may_be_similar(told("a"), told("b")).alias("m")).groupBy("s", "m").count().collect()
    found = {(r.s, r.m): r["count"] for r in got}
    assert (True, False) not in found and found[True, True] > 50 and found[False, False] > 100
