"""Scores at the edges of their bands, versions, names, normal forms."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.functions import versions as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def cases():
    return [
        (S.quality_score(F.lit(0), F.lit(0), F.lit(0)), 100.0),
        (S.quality_score(F.lit(30), F.lit(0), F.lit(0)), 0.0),
        (S.security_score(F.lit(11)), 0.0),
        (S.risk_level(F.lit(75)), "Critical"),
        (S.risk_level(F.lit(74)), "High"),
        (S.risk_level(F.lit(0)), "None"),
        (S.debt_rating(F.lit(0), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)), "A"),
        (S.debt_rating(F.lit(0), F.lit(1), F.lit(0), F.lit(0), F.lit(1.0)), "B"),
        (S.impact_risk(F.lit(0), F.lit(0)), 0),
        (S.impact_risk(F.lit(21), F.lit(101)), 25),
        (S.coverage_risk(F.lit(None).cast("double")), 12.5),
        (S.coverage_risk(F.lit(80.0)), 0.0),
        (S.test_grade(F.lit(59.9)), "F"),
        (S.quality_rating(F.lit(90)), "Excellent"),
        (S.trend(F.lit(0), F.lit(0), True), "Improving"),
        (S.trend(F.lit(0), F.lit(0), False), "Declining"),
        (S.trend(F.lit(100), F.lit(104), True), "Stable"),
        (S.trend(F.lit(100), F.lit(105), True), "Declining"),
        (S.simple_priority(F.lit("High"), F.lit(50), F.lit(30)), "QuickWin"),
        (S.api_score(F.lit(0), F.lit(0), F.lit(0), F.lit(1), F.lit(0)), 99.5),
        (S.modifier(F.lit(4), F.lit(0), F.lit(4)), 1.0),
        (S.modifier(F.lit(4), F.lit(1), F.lit(5)), 1.1),
        (S.transformation_gain(F.lit(False), F.lit(True), F.lit(0), F.lit(0), F.lit(0), F.lit(0)), -100.0),
        (T.mask(F.lit("12345678")), "****"),
        (T.mask(F.lit("123456789")), "1234****6789"),
        (T.first_sensitive(F.lit("a 4111-1111-1111-1111 b")), "CreditCard"),
        (T.first_sensitive(F.lit("userPassword")), None),
        (T.convention(F.lit("IThing")), "InterfacePrefix"),
        (T.convention(F.lit("word")), "LowerSnake"),
        (T.convention(F.lit("camelCase")), "Camel"),
        (T.words(F.lit("_parseXMLFile2")), ["parse", "xml", "file2"]),
        (T.recase(F.lit("parse_xml"), "Pascal"), "ParseXml"),
        (T.recase(F.lit("ParseXml"), "Camel"), "parseXml"),
        (T.plural(F.lit("query")), "queries"),
        (T.plural(F.lit("box")), "boxes"),
        (T.plural(F.lit("day")), "days"),
        (T.normal_code(F.lit('x =  "a"\n + 12 ')), 'x = "STR" + NUM'),
        (T.annotation(F.lit("a%b:c,d\n")), "a%25b%3Ac%2Cd%0A"),
        (T.file_size(F.lit(2048)), "2 KB"),
        (T.normal_key(F.lit(" A__B ")), "A:B"),
        (T.markers(F.lit("todo: hack")), ["TODO", "HACK"]),
        (V.parts(F.lit("1.x.3-beta.4")), [1, 0, 3]),
        (V.affected(F.lit("1.9"), F.lit("< 2.0.0")), True),
        (V.affected(F.lit("3.0.0"), F.lit("1.0 - 2.5")), False),
        (V.affected(F.lit("9.0.0"), F.lit("[1.0, 2.0)")), True),
        (V.affected(F.lit("1.0.0"), F.lit("(1.0, 2.0)")), False),
    ]


def test_values(spark):
    rows = cases()
    got = spark.range(1).select(*[column.alias(f"x{k}") for k, (column, _) in enumerate(rows)]).first()
    for k, (_, want) in enumerate(rows):
        assert got[k] == want, (k, got[k], want)


@pytest.mark.parametrize(("pattern", "text", "hit"), [("*Async", "DoItAsync", True), ("*async", "DOITASYNC", True), ("a?c", "abc", True), ("a?c", "abbc", False), ("a.c", "abc", False), ("x", "xx", False)])
def test_wildcards(spark, pattern, text, hit):
    assert value(spark, F.lit(text).rlike(T.wildcard(pattern))) is hit
