import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gritsieve.functions import scalars
from gritsieve.operators import aggregates, duplicates, groups, preview, profile, quality, relational, scaling
from gritsieve.operators.quantiles import quantile_columns
from gritsieve.plans import reports
from gritsieve.plans.cleaning import clean
from gritsieve.schema import MOVIE_COLUMNS, SemanticSchema

TITLES = [(451, "Alpha"), (21, "Bravo"), (21, "Bravo"), (333, "Charlie"), (333, "Charlie"), (333, "Charlie"), (4, "Delta"), (500, "Echo"), (500, "Echo")]


def titles(spark, extra=()):
    rows = [(i, *r) for i, r in enumerate([*TITLES, *extra])]
    return spark.createDataFrame(rows, "row_id bigint, id bigint, title string")


def test_find_duplicates(spark):
    found = duplicates.find_duplicates(titles(spark), "row_id").orderBy("id")
    assert [tuple(r) for r in found.select("id", "title", "count").collect()] == [(21, "Bravo", 2), (333, "Charlie", 3), (500, "Echo", 2)]
    with pytest.raises(ValueError):
        duplicates.find_duplicates(titles(spark).drop("title"), "row_id")


def test_duplicates_count_by_id_and_null_keys(spark):
    df = titles(spark, [(21, "Other"), (21, "Other"), (None, "N"), (None, "N"), (7, None), (7, None)])
    found = {r["id"]: (r["title"], r["count"]) for r in duplicates.find_duplicates(df, "row_id").collect()}
    assert found == {21: ("Bravo", 4), 333: ("Charlie", 3), 500: ("Echo", 2), 7: (None, 2)}


def test_remove_duplicates(spark):
    df = titles(spark)
    kept = duplicates.remove_duplicates(df, "row_id")
    assert [r[0] for r in kept.orderBy("row_id").select("row_id").collect()] == [0, 1, 3, 6, 7]
    assert duplicates.remove_duplicates(kept, "row_id").count() == kept.count()
    dropped = duplicates.remove_duplicates(df, "row_id", mode="drop_first")
    assert [r[0] for r in dropped.orderBy("row_id").select("row_id").collect()] == [0, 2, 4, 5, 6, 8]
    assert duplicates.duplicate_count(df, ["id", "title"]).first()[0] == 4
    assert sorted(r[0] for r in duplicates.repeated_rows(df, "row_id").select("row_id").collect()) == [2, 4, 5, 8]


def skewed(spark, n=3000):
    """A third of all rows under one key, some keys null."""
    rows = [(i, 1 if i % 3 == 0 else (None if i % 50 == 1 else i % 700)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, key bigint").repartition(4)


@pytest.mark.parametrize("heavy", [0.001, 0.1, 0.9])
def test_lookup_spreads_heavy_keys(spark, heavy):
    df = skewed(spark)
    facts = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("row_id").alias("top"))
    found = groups.lookup(df, facts, ["key"], ["top"], "n", heavy_share=heavy).toPandas()
    p = df.toPandas()
    expected = p.assign(top=p.groupby("key", dropna=False)["row_id"].transform("max"))
    merged = found.merge(expected, on="row_id", suffixes=("", "_e"))
    assert len(merged) == len(p) and (merged["top"] == merged["top_e"]).all()


def test_group_facts(spark):
    df = skewed(spark)
    p = df.toPandas().sort_values("row_id")
    size = groups.group_size(df, "key", "n").toPandas().sort_values("row_id")
    expected = p.groupby("key")["row_id"].transform("count")
    assert size["n"].fillna(-1).tolist() == expected.fillna(-1).tolist()
    dup = groups.flag_duplicates(df, ["key"]).toPandas().sort_values("row_id")
    assert dup["is_duplicate"].tolist() == p.duplicated(["key"], keep=False).tolist()
    rep = groups.flag_repeats(df, ["key"], "row_id").toPandas().sort_values("row_id")
    assert rep["is_repeat"].tolist() == p.duplicated(["key"]).tolist()


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_position_in_group(spark, blocks):
    df = skewed(spark)
    found = groups.position_in_group(df, ["key"], "row_id", blocks=blocks).toPandas().sort_values("row_id")
    p = df.toPandas().dropna().sort_values("row_id")
    assert found["position"].tolist() == (p.groupby("key").cumcount() + 1).tolist()


def test_running_total(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"k": rng.choice(5000, 400) - 1000, "v": rng.integers(0, 9, 400)})
    found = groups.running_total(spark.createDataFrame(p), "k", "v").toPandas()
    assert all(t == p.v[p.k <= k].sum() for k, t in zip(found["k"], found["running_total"]))
    published = {2: 5371, 3: 1705, 4: 550, 5: 178, 6: 62, 7: 14, 8: 6, 9: 5, 10: 1, 12: 1, 13: 1, 19: 1}
    df = spark.createDataFrame(list(published.items()), "n int, count bigint")
    last = groups.running_total(df, "n", "count").orderBy(F.desc("n")).first()
    assert last["running_total"] == 7895


@pytest.mark.parametrize("kind", ["normal", "heavy", "pair", "constant", "few"])
def test_quantiles_narrowed_to_the_exact_value(spark, kind):
    rng = np.random.default_rng(3)
    data = {
        "normal": rng.normal(size=4001),
        "heavy": np.where(rng.random(4000) < 0.4, 1.0, rng.exponential(size=4000)),
        "pair": np.concatenate([np.zeros(2000), np.linspace(0.1, 0.9, 101), np.ones(2000)]),
        "constant": np.full(500, 2.5),
        "few": np.array([3.0, 1.0]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": data}))
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    columns = quantile_columns(df, ["x"], shares, accuracy=50)
    found = df.agg(*[columns["x", s].alias(f"q{i}") for i, s in enumerate(shares)]).first()
    assert np.allclose(found, np.quantile(data, shares), rtol=1e-12, atol=1e-12)


def test_numeric_stats_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (float("nan"), 5.0, None), (3.0, 5.0, None), (4.0, 5.0, None), (9.0, 5.0, None)], "a double, b double, e double")
    stats = {r["column"]: r for r in aggregates.numeric_stats(df, ["a", "b", "e"]).collect()}
    s = pd.Series([1.0, 3.0, 4.0, 9.0])
    assert stats["a"]["count"] == 4 and stats["a"]["missing"] == 1
    assert np.isclose(stats["a"]["skewness"], s.skew()) and np.isclose(stats["a"]["kurtosis"], s.kurtosis())
    assert np.isclose(stats["a"]["iqr"], s.quantile(0.75) - s.quantile(0.25))
    assert (stats["b"]["skewness"], stats["b"]["kurtosis"], stats["b"]["std"]) == (0.0, 0.0, 0.0)
    assert stats["e"]["count"] == 0 and stats["e"]["mean"] is None and stats["e"]["skewness"] is None


def test_value_counts_and_mode(spark):
    ages = spark.createDataFrame([("a", 25), ("b", 30), ("c", 35), ("d", 25), ("e", 30)], "name string, age bigint")
    assert [tuple(r) for r in aggregates.value_counts(ages, "age").collect()] == [(25, 2), (30, 2), (35, 1)]
    row = aggregates.distinct_and_mode(ages, ["age"]).first()
    assert (row["n_unique"], row["mode"], row["mode_count"]) == (3, 25.0, 2)
    assert aggregates.describe_text(ages, ["name"]).first()["top"] == "a"
    assert ages.where("age > 99").agg(aggregates.null_percent(F.col("age"))).first()[0] is None


def test_scaling(spark):
    df = spark.createDataFrame([(i, float(v), 7.0) for i, v in enumerate([1, 2, 3, 4, 100])] + [(9, None, 7.0)], "i int, x double, k double")
    x = np.array([1, 2, 3, 4, 100.0])
    found = scaling.standard_scale(df, ["x", "k"]).orderBy("i").toPandas()
    assert np.allclose(found["x"][:5], (x - x.mean()) / x.std()) and np.isnan(found["x"][5])
    assert (found["k"] == 0).all()
    assert (scaling.minmax_scale(df, ["k"]).toPandas()["k"] == 0).all()
    scaled = scaling.standard_scale(df, ["x"])
    assert scaling.drop_outliers(scaled, ["x"], 1.5).count() == 4
    variants = scaling.compare_scalers(df.drop("k", "i"), "x", ["x"], threshold=1.5).toPandas().set_index("variant")
    assert variants.loc["dropped", "count"] == 4 and variants.loc["clamped", "max"] == 1.5
    assert variants.loc["dropped_minmax", "max"] == 1.0


def movies(spark):
    rows = [
        (0, "1", "A", "100", "[{'id': 18, 'name': 'Drama'}]", "True", "2020-01-05", None),
        (1, "1", "A", "100", "[{'id': 18, 'name': 'Drama'}]", "True", "2020-01-05", None),
        (2, "2", "B", "x.jpg", "[]", "no", "2020-1-5", None),
        (3, "3.0", " ", "300", "[{'id': 35, 'name': 'le'Comedy'}]", "False", "2021-02-28", None),
        (4, "4", "D", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "row_id bigint, id string, title string, budget string, genres string, adult string, release_date string, tagline string")


def test_validation_and_cleaning(spark):
    df = movies(spark)
    summary = {r["column"]: r for r in quality.validation_summary(df, MOVIE_COLUMNS).collect()}
    assert (summary["budget"]["status"], summary["budget"]["n_invalid"]) == ("invalid", 1)
    assert summary["row_id"]["status"] == "unregistered" and summary["tagline"]["status"] == "valid"
    typed, rejects = quality.null_out_invalid(df, MOVIE_COLUMNS, "row_id")
    bad = {(r["row_id"], r["column"], r["value"]) for r in rejects.collect()}
    assert bad == {(2, "budget", "x.jpg"), (2, "genres", "[]"), (2, "adult", "no"), (2, "release_date", "2020-1-5"), (3, "title", " ")}
    names = [c for c in df.columns if c != "row_id"]
    filled = lambda d: sum(d.agg(*[F.count(n) for n in names]).first())
    assert filled(df) == filled(typed) + len(bad)
    report = quality.error_report(df, MOVIE_COLUMNS, "r1")
    assert report["rejects"].count() == 5 and report["summary"].columns[0] == "run_id"

    result = clean(df, MOVIE_COLUMNS, "row_id")
    table = result.table.orderBy("row_id").toPandas()
    assert result.dropped_columns == ["tagline"] and table["row_id"].tolist() == [0, 2, 3, 4]
    ids = np.array([1, 2, 3, 4.0])
    assert np.allclose(table["id"], (ids - ids.mean()) / ids.std())
    assert [r["row_id"] for r in result.duplicates.collect()] == [1]
    assert result.rejects.count() == 5


def test_sparse_columns(spark):
    rows = [(1, None, None, None), (2, "a", None, None), (3, "b", "c", None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "a int, half string, quarter string, none string")
    assert quality.blank_columns(df) == ["none"]
    assert quality.sparse_columns(df) == ["quarter", "none"]
    assert quality.droppable_columns(df, 50) == ["half", "quarter", "none"]
    assert quality.droppable_columns(df.where("a > 9"), 50) == []


def test_profiles(spark):
    df = titles(spark).select("row_id", F.col("id").cast("string").alias("id"), "title")
    parts = profile.table_profile(df, MOVIE_COLUMNS, "row_id")
    assert tuple(parts["shape"].first()) == (9, 2)
    assert parts["duplicates"].count() == 3 and parts["columns_after"].count() == 2
    own = profile.column_profile(df, "id", MOVIE_COLUMNS)
    assert own["top_values"].first()["n"] == 3 and own["stats"].first()["mode"] == 333.0
    assert set(profile.all_columns_profile(df.drop("row_id"), MOVIE_COLUMNS)) == {"text", "numeric"}


def test_preview_grid(spark):
    rows = [(i, *[f"{ch}{i:09d}" for ch in "ABCDEFGHIJKL"]) for i in range(8)]
    df = spark.createDataFrame(rows, "row_id int, " + ", ".join(f"{ch} string" for ch in "ABCDEFGHIJKL"))
    shown = preview.grid(df, 3, "row_id", 8, 10)
    assert shown.columns == ["row_id", "A", "B", "C", "...", "J", "K", "L"]
    found = shown.collect()
    assert [r["row_id"] for r in found] == [0, 1, 2, 5, 6, 7] and found[0]["A"] == "A000000…  "
    assert preview.grid(df.where("row_id < 4"), 3, "row_id").count() == 4
    assert relational.short_names(df.select(F.lit(1).alias("abcdefg"), F.lit(2).alias("abcdxyz")), 5).columns == ["abcd…", "abcd…2"]


def test_reports(spark):
    rows = [("t1", "A", "99965753", "1"), ("t2", "B", "99423521", "2"), ("t3", "C", "9938268", "99999999"), ("t4", "D", "99357138", "x"), ("t5", "E", "99357138", ""), ("", "F", "5", "7"), ("t6", "G", "-5", "7")]
    df = spark.createDataFrame(rows, "imdb_id string, title string, revenue string, budget string")
    assert sorted(r["title"] for r in reports.nth_highest(df, "imdb_id", "revenue", 3).collect()) == ["D", "E"]
    assert reports.nth_highest(df, "imdb_id", "revenue", 3, ties=False, as_text=True).first()["title"] == "C"
    lost = reports.first_losses(df, "imdb_id", "revenue", "budget").collect()
    assert [(r["title"], int(r["profit"])) for r in lost] == [("C", 9938268 - 99999999)]


def test_genres(spark):
    rows = [("[{'id': 1, 'name': 'A'}, {'id': 2, 'name': 'B'}]", "100", "2020-01-01"), ("[{'id': 2, 'name': 'B'}]", "201", "2020-01-02"), ("[]", "5", "2020-01-03"), ("False", "5", "2020-01-04"), (None, "5", None)]
    df = spark.createDataFrame(rows, "genres string, revenue string, day string")
    found = [tuple(r) for r in reports.average_by_item(df, "genres", "revenue").collect()]
    assert found == [('{"id":2,"name":"B"}', 151), ('{"id":1,"name":"A"}', 100)]
    top = reports.top_item_per_month(df, "genres", scalars.release_month(F.col("day"))).collect()
    assert [tuple(r) for r in top] == [(1, '{"id":2,"name":"B"}', 2)]
    assert tuple(reports.list_length_range(df, "genres").first()) == (0, 2)
    dimension, bridge = relational.normalise(df.withColumn("k", F.monotonically_increasing_id()), "k", "genres", {"id": "bigint", "name": "string"}, "id")
    assert (dimension.count(), bridge.count()) == (2, 3)


def test_head_and_tail_and_ranks(spark):
    df = spark.range(5).withColumn("v", F.col("id") % 3)
    assert sorted(r[0] for r in relational.head_and_tail(df, 4, "id").select("id").collect()) == [0, 1, 2, 3, 4]
    assert relational.nth_row(df, 2, F.desc("id")).first()[0] == 3
    assert sorted(r["id"] for r in relational.nth_value_rows(df, 2, "v").collect()) == [1, 4]


def test_lookup_shuffles_by_key_and_salt(spark):
    """Heavy keys and rows without a key spread: the salt is among the exchange's keys."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS k")
        sized = groups.group_size(df, "k")
        plan = sized._jdf.queryExecution().executedPlan().toString()
        shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "salt" in line]
        assert shuffled and "(__salt" not in plan.split("SortMergeJoin")[1].split("\n")[0].split("LeftOuter")[-1]
        rows = {r["id"]: r["group_size"] for r in sized.collect()}
        assert all(rows[i] == (None if i % 3 == 0 else 667 if i % 3 == 1 else 1) for i in range(2000))
        spread = sized.rdd.glom().map(len).collect()
        assert max(spread) < 4 * sum(spread) / len(spread)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_running_total_with_a_far_order(spark):
    """One order far from all others does not put the rest in one block."""
    df = spark.range(20_000).selectExpr("CASE WHEN id = 0 THEN 4000000000000000000 ELSE id DIV 2 END AS o", "1 AS v", "id")
    blocks = groups.blocks_of(df.groupBy("o").count(), "o", 8).groupBy("__block").count().collect()
    assert len(blocks) == 8 and max(b["count"] for b in blocks) < 2 * 10_000 / 8 + 100
    rows = groups.running_total(df, "o", "v").collect()
    assert len(rows) == 20_000
    assert all(r["running_total"] == (20_000 if r["o"] > 10**6 else 2 * r["o"] + 1) for r in rows)


def test_running_total_of_unique_orders(spark):
    rows = [(i, i * i % 13) for i in range(500)] + [(None, 5)]
    df = spark.createDataFrame(rows, "o long, v long").repartition(4)
    found = {r["o"]: r["t"] for r in groups.running_total(df, "o", "v", "t", unique=True).collect()}
    total, want = 0, {None: None}
    for o, v in rows[:500]:
        total += v
        want[o] = total
    assert found == want
    assert groups.running_total(df.limit(0), "o", "v", unique=True).collect() == []
