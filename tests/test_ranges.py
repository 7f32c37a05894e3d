import pytest
from pyspark.sql import functions as F

from pageloom.functions.ranges import page_groups, rule_pages, shown_pages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "spec, total, groups",
    [("2-4,1,6-7", 9, [[2, 3, 4], [1], [6, 7]]), ("3,1,3", 5, [[3], [1], [3]]), (",", 5, []), (" 2 ,\t4-4 ", 5, [[2], [4]]), ("5", 5, [[5]])],
)
def test_groups(spark, spec, total, groups):
    x = one(spark, page_groups(F.lit(spec), F.lit(total)))
    assert x["groups"] == groups and x["error"] is None


@pytest.mark.parametrize(
    "spec, part",
    [("", "no pages"), ("  ", "no pages"), (None, "no pages"), ("5-3", "backwards"), ("0", "outside"), ("9", "outside"), ("9-8", "backwards"), ("a", "not a page"), ("1-2-3", "not a page"), ("1,9,a", "'9'"), ("99999999999999999999", "outside"), ("-2", "not a page")],
)
def test_group_errors(spark, spec, part):
    total = 10 if spec == "9-8" else 5
    x = one(spark, page_groups(F.lit(spec).cast("string"), F.lit(total)))
    assert x["groups"] is None and part in x["error"]


@pytest.mark.parametrize("spec, pages", [("", [1, 2, 3]), ("3-1,2", [3, 2, 1, 2]), ("1,1", [1, 1]), (",", [])])
def test_rule_pages(spark, spec, pages):
    assert one(spark, rule_pages(F.lit(spec), F.lit(3)))["pages"] == pages


def test_rule_pages_outside(spark):
    assert one(spark, rule_pages(F.lit("2-5"), F.lit(3)))["error"]
    assert one(spark, rule_pages(F.lit("2-5"), F.lit(3), inside=False))["pages"] == [2, 3, 4, 5]
    assert one(spark, rule_pages(F.lit(""), F.lit(0)))["pages"] == []
    assert one(spark, rule_pages(F.lit("x"), F.lit(3)))["error"]


@pytest.mark.parametrize("spec, pages", [("", [1, 2, 3]), ("5-3", []), ("2-99", [2, 3]), ("9,2", [2]), ("2abc", [2]), ("1-2-3", [1, 2]), ("-2", []), ("x,,3", [3]), ("0-1", [1])])
def test_shown_pages(spark, spec, pages):
    assert one(spark, shown_pages(F.lit(spec), F.lit(3))) == pages
