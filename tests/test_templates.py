"""Filter templates: exported, read back and applied against plain conditions."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import templates as tp
from helixframe.operators import variants as va

KNOWN = [("DP", "10,3"), ("DP", "50,."), ("DP", "7"), ("FLAG", "A"), ("FLAG", "it's"), ("FLAG", "b\\c"), ("ONE", "same"), ("NUM", "5"), ("NONE", "."),
         ("T/AF", "0.5,x"), ("T/AF", "0.25,y"), ("a/b/AF", "1e-3")]


def test_rules_are_written_read_and_applied(spark, tmp_path):
    ranges = va.field_ranges(spark.createDataFrame(KNOWN, "field string, value string"))
    tp.write_template(tp.template_rules(ranges), str(tmp_path / "rules"))
    rules = tp.read_template(spark, str(tmp_path / "rules"))
    assert rules == [
        "7.0 <= float(record.info['DP'][0]) <= 50.0", "3.0 <= float(record.info['DP'][1]) <= 3.0",
        r"record.info['FLAG'] in {'A', 'b\\c', 'it\'s'}", "5.0 <= float(record.info['NUM']) <= 5.0",
        "0.25 <= float(record.samples['T']['AF'][0]) <= 0.5", "record.samples['T']['AF'][1] in {'x', 'y'}",
        "0.001 <= float(record.samples['a/b']['AF']) <= 0.001",
    ]
    rows = [
        (1, {"DP": "7,3", "FLAG": "it's", "NUM": "5"}, {"T": {"AF": "0.3,x"}, "a/b": {"AF": "0.001"}}),
        (2, {"DP": "6,3", "FLAG": "A", "NUM": "5"}, {"T": {"AF": "0.3,x"}, "a/b": {"AF": "0.001"}}),
        (3, {"DP": "7", "FLAG": "b\\c", "NUM": "5"}, {"T": {"AF": "0.3,y"}, "a/b": {"AF": "0.001"}}),
        (4, {"DP": "7,3", "FLAG": "B", "NUM": "5"}, {"T": {"AF": "0.3,x"}, "a/b": {"AF": "0.001"}}),
        (5, {"DP": "7,3", "FLAG": "A", "NUM": "."}, {"T": {"AF": "0.3,x"}}),
        (6, {"DP": "7,3", "FLAG": "A", "NUM": "five"}, None), (7, None, None),
    ]
    records = spark.createDataFrame(rows, "id int, info map<string,string>, samples map<string,map<string,string>>")
    assert [r.id for r in tp.apply_rules(records, rules).collect()] == [1]
    assert sorted(r.id for r in tp.apply_rules(records, rules, keep_missing=True).collect()) == [1, 3, 5, 6, 7]
    assert tp.apply_rules(records, []).count() == 7


def test_categories_between_two_and_the_limit(spark):
    ranges = va.field_ranges(spark.range(101).select(F.lit("ID").alias("field"), F.concat(F.lit("i"), "id").alias("value")))
    assert tp.template_rules(ranges).count() == 0 and tp.template_rules(ranges, most=101).count() == 1


def test_comparisons_and_other_texts(spark):
    df = spark.createDataFrame([({"DP": "9,x"},), ({"DP": "10,y"},)], "info map<string,string>")
    for rule, n in [("float(record.info['DP'][0]) >= 10", 1), ("float(r.info['DP'][0]) != 1e1", 1), ("record.info['DP'][1] not in {'x'}", 1), ("float(record.info['DP'][0]) < 100", 2)]:
        assert df.filter(tp.condition(rule)).count() == n
    for rule in ("__import__('os')", "record.info['DP'] in {}", "1 <= float(record.info['DP']) <= 2 or True", "record.info['A']['B'] in {'x'}", "record.samples['A'] in {'x'}"):
        with pytest.raises(ValueError):
            tp.condition(rule)
