"""Protein families judged in one pass over the domain counts."""

from helixframe.operators import rules as ru


def test_families_need_one_pass(spark):
    text = "family string, subfamily string, binding string, auxiliary string, forbidden string"
    rules = ru.parse_family_rules(spark.createDataFrame([
        ("A", "A1", "D (1) (PF1)", "-", "D (PF3)"), ("B", "B2", "D (PF2) and D (PF4)", "D (PF5)", "-"), ("B", "B3", "D (PF2)", "-", "-")], text))
    counts = spark.createDataFrame([
        ("barred", "PF1", 1), ("barred", "PF3", 1), ("plain", "PF1", 1), ("many", "PF1", 2), ("half", "PF4", 1),
        ("loose", "PF2", 1), ("loose", "PF4", 1), ("full", "PF2", 1), ("full", "PF4", 1), ("full", "PF5", 3)], "query_id string, domain string, n long")
    out = ru.judge_families(counts, rules)
    assert {(r["query_id"], r["family"]) for r in out.collect()} == {("plain", "A1"), ("loose", "B"), ("loose", "B3"), ("full", "B2"), ("full", "B3")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
