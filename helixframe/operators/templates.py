"""Filter templates of variant records as text, and such texts as conditions.

A rule is one line: `0.0 <= float(record.info['DP'][0]) <= 50.0`, `record.info['FLAG'] in {'A', 'N'}`,
`record.samples['T']['AF'][1] in {'x', 'y'}`, or a comparison such as `float(record.info['DP']) >= 10`.
Rules are matched against these forms and become columns; a text of any other form is an error and is never run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = r"'(?:[^'\\]|\\.)*'"
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_PATH = rf"\w+\.(?P<section>info|samples)(?P<keys>(?:\[{_TEXT}\])+)(?:\[(?P<place>\d+)\])?"
_RANGE = re.compile(rf"\s*(?P<low>{_NUMBER})\s*<=\s*float\({_PATH}\)\s*<=\s*(?P<high>{_NUMBER})\s*")
_COMPARED = re.compile(rf"\s*float\({_PATH}\)\s*(?P<sign><=|>=|==|!=|<|>)\s*(?P<limit>{_NUMBER})\s*")
_MEMBER = re.compile(rf"\s*{_PATH}\s+(?P<no>not\s+)?in\s+\{{\s*(?P<values>{_TEXT}(?:\s*,\s*{_TEXT})*)\s*\}}\s*")
_SIGNS = {
    "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__,
}


def _quoted(column: Column) -> Column:
    escaped = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def _unquoted(texts: str) -> list[str]:
    return [re.sub(r"\\(.)", r"\1", t[1:-1]) for t in re.findall(_TEXT, texts)]


def template_rules(ranges: DataFrame, most: int = 100, name: str = "record") -> DataFrame:
    """(field, place, rule) of `variants.field_ranges`.

    A field `DP` is one of INFO; `T/DP` is the field DP of sample T. A place is written only if its field has several.
    Numbers give a range, also if both ends are equal; categories give a set if there are two to `most` of them: a
    single one tells nothing apart, and fields with more are not filtered by.
    """
    places = ranges.groupBy("field").agg(F.count_distinct("place").alias("places"))
    sample, key = F.regexp_extract("field", "^(.*)/[^/]*$", 1), F.regexp_extract("field", "([^/]*)$", 1)
    inside = F.when(F.contains("field", F.lit("/")), F.concat(F.lit(f"{name}.samples["), _quoted(sample), F.lit("][")))
    start = F.concat(F.coalesce(inside, F.lit(f"{name}.info[")), _quoted(key), F.lit("]"))
    index = F.when(F.col("places") > 1, F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]"))).otherwise("")
    rows = ranges.join(places, "field").withColumn("path", F.concat(start, index))
    low, high = (F.col(c).cast("string") for c in ("low", "high"))
    numbers = rows.filter("kind = 'range'").select(
        "field", "place", F.concat(low, F.lit(" <= float("), "path", F.lit(") <= "), high).alias("rule"))
    few = rows.filter((F.col("kind") == "category") & F.col("n").between(2, most))
    sets = few.groupBy("field", "place", "path").agg(F.array_sort(F.collect_list(_quoted(F.col("category")))).alias("all"))
    sets = sets.select("field", "place", F.concat("path", F.lit(" in {"), F.array_join("all", ", "), F.lit("}")).alias("rule"))
    return numbers.union(sets)


def write_template(rules: DataFrame, path: str) -> None:
    rules.write.json(path)


def read_template(spark: SparkSession, path: str) -> list[str]:
    """The rule texts of a written template, by field and place; as many as the records have fields and places."""
    rows = spark.read.schema("field string, place int, rule string").json(path)
    return [r["rule"] for r in rows.orderBy("field", "place").collect()]


def _value(rule: re.Match, info: str, samples: str) -> Column:
    keys = _unquoted(rule["keys"])
    if len(keys) != (1 if rule["section"] == "info" else 2):
        raise ValueError(f"not a field of a record: {rule.string}")
    value = F.col(info if rule["section"] == "info" else samples)
    for key in keys:
        value = F.try_element_at(value, F.lit(key))
    if rule["place"] is not None:
        value = F.get(F.split(value, ","), F.lit(int(rule["place"])))
    return F.nullif(value, F.lit("."))


def condition(rule: str, info: str = "info", samples: str = "samples") -> Column:
    """A rule as a condition on `info` (map of texts) and `samples` (map of such maps); null where the record has no
    such value, or none that is a number."""
    if (found := _RANGE.fullmatch(rule)) is not None:
        return _value(found, info, samples).try_cast("double").between(float(found["low"]), float(found["high"]))
    if (found := _COMPARED.fullmatch(rule)) is not None:
        return _SIGNS[found["sign"]](_value(found, info, samples).try_cast("double"), F.lit(float(found["limit"])))
    if (found := _MEMBER.fullmatch(rule)) is not None:
        member = _value(found, info, samples).isin(_unquoted(found["values"]))
        return ~member if found["no"] else member
    raise ValueError(f"not a rule: {rule}")


def apply_rules(records: DataFrame, rules: Iterable[str], keep_missing: bool = False, info: str = "info", samples: str = "samples") -> DataFrame:
    """The records that meet all rules. A record without the value of a rule fails it, or passes with `keep_missing`.
    Without rules all records stay."""
    met = [F.coalesce(condition(rule, info, samples), F.lit(keep_missing)) for rule in rules]
    return records.filter(reduce(lambda a, b: a & b, met)) if met else records
