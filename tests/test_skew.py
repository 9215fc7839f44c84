"""Lookups and ranks with hot keys."""

from quillspan.operators import skew


def test_lookup_of_hot_keys(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(100)] + [(f"k{k}", k) for k in range(20)] + [(None, 1), ("none", 2)], "key string, v int")
    stats = rows.where("key <> 'none'").groupBy("key").count().withColumnRenamed("count", "n").where("key IS NOT NULL")
    got = skew.lookup(rows, stats, "key", "n", most=4)
    assert got.count() == 120 and sorted(got.columns) == ["key", "n", "v"]
    assert got.where("key = 'hot' AND n = 100").count() == 100


def test_rank_in_group_is_dense_with_any_salts(spark):
    rows = spark.createDataFrame([("a" if k % 3 else None, k) for k in range(200)], "g string, v int")
    for salts in (1, 7):
        got = skew.rank_in_group(rows, ["g"], ["v"], salts).collect()
        for g in ("a", None):
            own = sorted(r["rank_in_group"] for r in got if r["g"] == g)
            assert own == list(range(len(own)))


def test_split_ranks_of_large_groups(spark):
    rows = spark.createDataFrame([("a", k, float(k * 7919 % 101)) for k in range(400)] + [("b", 1, 5.0), ("b", 2, 5.0)], "g string, k int, x double")
    columns = ["g", "k", "x", "n", "above_x", "ties_x"]
    small = sorted(skew.split_ranks(rows, "g", ["x"]).select(columns).collect())
    large = sorted(skew.split_ranks(rows, "g", ["x"], most=10, splits=8).select(columns).collect())
    assert small == large
    values = [r["x"] for r in rows.where("g = 'a'").collect()]
    assert all(r["above_x"] == sum(v > r["x"] for v in values) for r in small if r["g"] == "a")
