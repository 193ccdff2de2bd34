import pytest
from pyspark.errors import PySparkException

from marketgrain.operators import quality
from marketgrain.operators.keys import checked_join, first_per_key, unique_rows


def test_composite_key_is_accepted(spark):
    quality.require_unique(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int"), ["a", "b"], "t")


@pytest.mark.parametrize("rows, word", [([(1, 1), (1, 1)], "not unique"), ([(1, None)], "nulls")])
def test_broken_key_is_refused(spark, rows, word):
    with pytest.raises(quality.ContractError, match=word):
        quality.require_unique(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], "t")


def test_checked_join_keeps_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (9,), (1,)], "id int")
    right = spark.createDataFrame([(1, 3), (2, 4)], "id int, v int")
    rows = sorted((r["id"], r["v"]) for r in checked_join(left, right, "id").collect())
    assert rows == [(1, 3), (1, 3), (2, 4), (9, None)]


def test_checked_join_fails_on_a_multiplying_key(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    right = spark.createDataFrame([(1, 3), (1, 4)], "id int, v int")
    with pytest.raises(PySparkException, match="not unique"):
        checked_join(left, right, "id").collect()
    # also when only the left columns are read afterwards
    with pytest.raises(PySparkException, match="not unique"):
        checked_join(left, right, "id", "inner").select("id").collect()


def test_one_to_one_join_checks_the_left_side(spark):
    left = spark.createDataFrame([(1,), (1,)], "id int")
    right = spark.createDataFrame([(1, 3)], "id int, v int")
    with pytest.raises(PySparkException, match="left side"):
        checked_join(left, right, "id", expect="1:1").collect()


def test_unique_rows_is_the_table(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert unique_rows(frame, ["id"], "t").exceptAll(frame).count() == 0
    assert unique_rows(frame, ["id"], "t").count() == 2


def test_first_per_key_in_total_order(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("a", 2, 1), ("a", 2, 0), ("a", 3, 5), ("b", 1, 1)], "k string, v int, t int")
    rows = {(r["k"], r["v"], r["t"]) for r in first_per_key(frame, ["k"], [F.asc("v"), F.asc("t")]).collect()}
    assert rows == {("a", 2, 0), ("b", 1, 1)}


def test_key_finding_counts(spark):
    frame = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (3,), (3,)], "k int")
    row = quality.key_finding(frame, "t", ["k"]).first()
    assert (row["rows"], row["missing_rows"], row["repeated_keys"], row["duplicate_rows"], row["is_key"]) == (7, 1, 2, 5, False)


def test_leaking_features_are_refused():
    from marketgrain.ml import delivery

    quality.require_disjoint([*delivery.NUMERIC, *delivery.CATEGORICAL], delivery.FORBIDDEN)
    with pytest.raises(quality.ContractError, match="late_delivery"):
        quality.require_disjoint(["item_count", "late_delivery"], delivery.FORBIDDEN)


def test_missing_columns_are_named(spark, small):
    with pytest.raises(quality.ContractError, match="order_approved_at"):
        quality.require_columns(small.tables, {"orders": ["order_id", "order_approved_at"]})
    quality.require_columns(small.tables, {"orders": ["order_id"]})


def test_join_multiplication_counts_without_joining(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    right = spark.createDataFrame([(1,), (1,), (1,), (5,)], "id int")
    row = quality.join_multiplication("j", left, right, ["id"]).first()
    assert (row["rows_before"], row["rows_after"], row["multiplies"]) == (4, 8, True)
    assert left.join(right, "id", "left").count() == 8


def test_profiles(spark):
    rows = [("2018-01-01", 0.0, " a"), ("bad", -1.0, "b"), (None, float("inf"), "b"), ("2018-02-01", None, None)]
    frame = spark.createDataFrame(rows, "some_date string, n double, t string")
    dates = quality.date_profile(frame, "t").first()
    assert (dates["valid"], dates["invalid_non_null"]) == (2, 1)
    numbers = quality.numeric_profile(frame, "t").first()
    assert (numbers["zero_count"], numbers["negative_count"], numbers["non_finite_count"]) == (1, 1, 1)
    texts = {(r["value"], r["copies"], r["place"]) for r in quality.top_values(frame, "t", ["t"]).collect()}
    assert texts == {("b", 2, 1), (" a", 1, 2), (None, 1, 3)}
    assert quality.top_values(frame, "t", ["t"]).first()["padded_rows"] == 1
    columns = {r["column_name"]: r for r in quality.column_profile(frame, "t").collect()}
    assert (columns["t"]["nulls"], columns["t"]["null_percentage"], columns["t"]["distinct_values"]) == (1, 25.0, 2)


def test_quarantine_splits_every_row(spark):
    frame = spark.createDataFrame([(1,), (-1,), (None,)], "price int")
    good, bad = quality.quarantine(frame, ["price >= 0"])
    assert (good.count(), bad.count()) == (2, 1)


def test_audit_names_what_fails(spark):
    audit = spark.createDataFrame([("fine", True), ("broken", False)], "check_name string, ok boolean")
    with pytest.raises(quality.ContractError, match="broken"):
        quality.require_ok(audit)
