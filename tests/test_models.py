import pytest
from pyspark.sql import functions as F

from tiescope.catalog import models as catalog
from tiescope.ml import metrics, models
from tiescope.operators import sampling
from tiescope.operators.features import CORE_FEATURES


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"u{n}", f"v{n}", n % 7 / 7 + (0.3 if n % 3 == 0 else 0.0), int(n % 3 == 0), float(n % 5)) for n in range(300)]
    return spark.createDataFrame(rows, "user1 string, user2 string, score double, label int, other double")


def test_hand_confusion(spark):
    rows = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 3
    predictions = spark.createDataFrame(rows, "label int, prediction int")
    assert {(r["label"], r["prediction"]): r["rows"] for r in metrics.confusion(predictions).collect()} == {
        (1, 1): 6, (1, 0): 2, (0, 1): 1, (0, 0): 3}
    rows = {row["label"]: row for row in metrics.per_class(predictions).collect()}
    assert rows[1]["precision"] == pytest.approx(6 / 7) and rows[1]["recall"] == pytest.approx(6 / 8)
    assert rows[0]["precision"] == pytest.approx(3 / 5) and rows[0]["recall"] == pytest.approx(3 / 4)
    expected = (6 * 3 - 1 * 2) / (7 * 8 * 4 * 5) ** 0.5
    assert metrics.matthews(predictions).first()["mcc"] == pytest.approx(expected)
    never = predictions.withColumn("prediction", F.lit(0))
    assert metrics.matthews(never).first()["mcc"] == 0.0


def test_auc_by_pairs_of_rows(table):
    rows = table.select("label", "score").collect()
    good, bad = [[r["score"] for r in rows if r["label"] == value] for value in (1, 0)]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert metrics.roc_auc(table).first()["auc"] == pytest.approx(wins / len(good) / len(bad))


def test_auc_equals_evaluator(table):
    table = table.withColumnRenamed("score", "strength")
    result = models.scored(models.fit_baseline(table, "strength"), table)
    assert metrics.roc_auc(result).first()["auc"] == pytest.approx(metrics.area_under(result), abs=1e-6)


def test_balanced_weights(table):
    totals = {row["label"]: row["w"] for row in models.balanced(table).groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert totals[0] == pytest.approx(150) and totals[1] == pytest.approx(150)


def test_forest_separates(table):
    table = table.withColumnRenamed("score", "strength")
    forest = models.fit_forest(table, ["strength", "other"], trees=5)
    assert metrics.roc_auc(models.scored(forest, table)).first()["auc"] > 0.8
    ranked = models.importances(forest, ["strength", "other"], table.sparkSession).collect()
    assert {row["feature"] for row in ranked} == {"strength", "other"} and sum(r["importance"] for r in ranked) == pytest.approx(1)


def test_search_scores_every_pair(spark, monkeypatch):
    """The fits take a sample, the areas all pairs, each in one fold."""
    rows = [(n, n + 1, float(n % 11), float(n % 5), int(n % 11 > 6)) for n in range(900)]
    table = spark.createDataFrame(rows, "user1 bigint, user2 bigint, strength double, other double, label int")
    fitted, tested = [], []
    fit, areas = models.fit_forest, metrics.roc_areas
    monkeypatch.setattr(models, "fit_forest", lambda train, *a, **b: fitted.append(train.count()) or fit(train, *a, **b))
    monkeypatch.setattr(metrics, "roc_areas", lambda scored, *a: tested.append(scored.count()) or areas(scored, *a))
    found = models.search_forest(table, ["strength", "other"], draws=2, trees=3, rows=100)
    assert len(found) == 2 and all(0.9 < area <= 1 for _, _, area in found)
    assert len(fitted) == 6 and all(50 < n < 170 for n in fitted)
    assert len(tested) == 3 and sum(tested) == 2 * 900


def test_areas_of_groups(table):
    both = table.withColumn("side", F.lit(0)).unionByName(
        table.withColumns({"side": F.lit(1), "score": F.col("other")}))
    got = {row["side"]: row["auc"] for row in metrics.roc_areas(both, "side").collect()}
    for side, score in enumerate(("score", "other")):
        assert got[side] == pytest.approx(metrics.roc_auc(table, score).first()["auc"])


def test_resampling_sizes(spark):
    rows = [(n, n + 1, int(n % 4 == 0)) for n in range(400)]
    table = spark.createDataFrame(rows, "user1 bigint, user2 bigint, label int")

    def sizes(df):
        return {row["label"]: row["count"] for row in df.groupBy("label").count().collect()}
    assert sizes(sampling.undersample(table)) == {0: 100, 1: 100}
    assert sampling.undersample(table).distinct().count() == 200
    over = sampling.oversample(table)
    assert sizes(over) == {0: 300, 1: 300}
    assert over.filter("label = 0").distinct().count() == 300
    assert over.filter("label = 1").join(table, ["user1", "user2", "label"], "left_anti").count() == 0


@pytest.fixture(scope="module")
def many(spark):
    """More pairs than forests and search were once fitted on."""
    return spark.range(30_000).select(
        F.col("id").alias("user1"), (F.col("id") + 1).alias("user2"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        (F.col("id") % 2).cast("int").alias("two_unique"), *[(F.col("id") % (k + 2)).cast("double").alias(name) for k, name in enumerate(CORE_FEATURES)])


def test_forests_are_fitted_on_all_pairs(many, monkeypatch):
    fitted = []
    monkeypatch.setattr(catalog, "both_sets", lambda t: (many, many))
    monkeypatch.setattr(catalog, "train_set", lambda t: many)
    monkeypatch.setattr(catalog, "scores", lambda model, table: table)
    monkeypatch.setattr(models, "importances", lambda model, *a: model)
    monkeypatch.setattr(models, "two_fold", lambda train, test, fit: (fit(train), fit(test)))
    monkeypatch.setattr(models, "fold_report", lambda found, *a: found)
    monkeypatch.setattr(models, "out_of_fold", lambda train, test, fit: ((fit(train), fit(test)), None))
    monkeypatch.setattr(models, "fit_forest", lambda train, *a, **b: fitted.append(train.count()))
    for name, fits in (("forest", 1), ("scaled_forest", 1), ("forest_importances", 1), ("two_fold", 2), ("fold_report", 2)):
        fitted.clear()
        getattr(catalog, name)(type("Tables", (), {"spark": many.sparkSession}))
        assert fitted == [30_000] * fits, name


@pytest.mark.parametrize("name", ["search", "best"])
def test_search_is_fitted_on_all_pairs(many, monkeypatch, name):
    """Each setting on the pairs of two folds, the best one on all of them."""
    fitted = []
    monkeypatch.setattr(catalog, "both_sets", lambda t: (many, many))
    monkeypatch.setattr(catalog, "train_set", lambda t: many)
    monkeypatch.setattr(models, "_areas_of", lambda settings, train, *a: fitted.append((len(settings), train.count())) or [0.5] * len(settings))
    getattr(catalog, name)(type("Tables", (), {"spark": many.sparkSession}))
    if name == "best":
        assert fitted.pop() == (1, 30_000)
    assert sum(settings for settings, _ in fitted) == 18 * 3
    assert sum(settings * rows for settings, rows in fitted) == 18 * 2 * 30_000


@pytest.mark.parametrize("scaled", [False, True])
def test_forest_in_groups_of_trees(table, scaled):
    """Trees that are fitted some at a time make one forest; every tree draws as many rows as there are."""
    table = table.withColumnRenamed("score", "strength")
    model = models.fit_forest(table, ["strength", "other"], trees=7, scaled=scaled, bag_draws=3 * 300)
    forest = model.stages[-1]
    assert len(forest.trees) == forest.getNumTrees == forest.getOrDefault("numTrees") == 7
    drawn = [sum(tree._java_obj.rootNode().impurityStats().stats()) for tree in forest.trees]
    assert all(200 < rows < 400 for rows in drawn) and drawn[:3] != drawn[3:6]
    assert metrics.roc_auc(models.scored(model, table)).first()["auc"] > 0.8
    ranked = models.importances(model, ["strength", "other"], table.sparkSession).collect()
    assert sum(row["importance"] for row in ranked) == pytest.approx(1)
    whole = models.fit_forest(table, ["strength", "other"], trees=3, scaled=scaled)
    same = models.fit_forest(table, ["strength", "other"], trees=3, scaled=scaled, bag_draws=3 * 300)
    assert whole.stages[-1].toDebugString.split("\n", 1)[1] == same.stages[-1].toDebugString.split("\n", 1)[1]
