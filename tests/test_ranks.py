import numpy as np
import pandas as pd
import pytest

from marketgrain.operators import ranks
from marketgrain.plans.customer_value import customer_value
from marketgrain.sources.writers import with_row_keys


@pytest.fixture(autouse=True, params=["one range", "many ranges"])
def ranges(request, spark):
    """Small tables fit one range; the second run keeps every range the partitioner made."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, str(request.param == "one range").lower())
    yield
    spark.conf.set(name, "true")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value and half of them one group."""
    generator = np.random.default_rng(3)
    n = 3000
    value = np.where(generator.random(n) < 0.33, 7.0, np.round(generator.exponential(50, n), 2))
    group = np.where(generator.random(n) < 0.5, "hot", generator.choice(list("abcdef"), n))
    frame = pd.DataFrame({"id": range(n), "g": group, "v": value})
    return frame, spark.createDataFrame(frame)


def test_percent_rank_equals_pandas(skewed):
    frame, df = skewed
    want = frame.assign(p=frame.v.rank(pct=True, method="average")).groupby("v").p.first()
    got = ranks.average_percent_rank(df, "v").toPandas().set_index("v")["percent"]
    assert len(got) == len(want)
    assert np.allclose(got.sort_index(), want.sort_index(), rtol=0, atol=1e-12)


def test_quantiles_equal_pandas(skewed):
    frame, df = skewed
    fractions = [0.0, 0.1, 0.5, 0.99, 1.0]
    want = frame.groupby("g").v.quantile(fractions)
    got = ranks.exact_quantiles(df, "v", fractions, ["g"]).toPandas().set_index(["g", "fraction"])["quantile"]
    assert np.allclose(got.sort_index(), want.sort_index(), atol=1e-9)
    whole = ranks.exact_quantiles(df, "v", [0.99]).first()["quantile"]
    assert whole == pytest.approx(frame.v.quantile(0.99))


def test_running_totals_in_both_directions(skewed):
    frame, df = skewed
    counted = df.groupBy("g", "v").count().withColumnRenamed("count", "n")
    for descending in (False, True):
        got = ranks.running_totals(counted, ["v"], ["n"], ["g"], descending).toPandas()
        got = got.sort_values(["g", "v"], ascending=[True, not descending])
        assert (got.groupby("g").n.cumsum() - got.n == got.n_before).all()
        assert (got.groupby("g").n.transform("sum") == got.n_total).all()


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.8])
def test_row_at_a_position(skewed, fraction):
    frame, df = skewed
    row = ranks.row_at(df, ["v", "id"], fraction).first()
    want = frame.sort_values(["v", "id"]).iloc[int(fraction * len(frame))]
    assert (row["v"], row["id"], row["rows"]) == (want.v, want.id, len(frame))


def test_value_tiers_equal_pandas(skewed):
    frame, df = skewed
    percent = frame.v.rank(pct=True, method="average")
    want = np.select([percent >= 0.95, percent >= 0.75, percent >= 0.40], ["Top 5%", "High Value", "Developing"], "Low Value")
    got = customer_value(df.withColumnRenamed("v", "total_spend")).toPandas().sort_values("id")
    assert (got.value_tier.to_numpy() == want).all()


def test_row_keys_are_dense(skewed):
    frame, df = skewed
    got = with_row_keys(df, ["v", "id"]).toPandas().sort_values("row_key")
    assert got.row_key.tolist() == list(range(1, len(frame) + 1))
    assert got.id.tolist() == frame.sort_values(["v", "id"]).id.tolist()


def test_the_second_run_has_many_ranges(spark, skewed):
    frame, df = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert df.repartitionByRange("v", "id").rdd.getNumPartitions() > 1
