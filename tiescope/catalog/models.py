"""Models and their evaluation.

Fitted models have no SQL twin. The evaluation queries score pairs by a rule
(the number of co-occurrences), so that every metric can be checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tiescope.catalog.base import Query, r6, sql
from tiescope.ml import metrics, models
from tiescope.operators.features import CORE_FEATURES, labelled_places
from tiescope.plans.dataset import build_dataset
from tiescope.plans.inputs import CONFIG, PERIODS, Inputs
from tiescope.session import stage

#: What is written of the sets: the columns that the baseline and the forests take.
COLUMNS = ["user1", "user2", "label", "two_unique", *CORE_FEATURES]


def both_sets(t: Inputs):
    train, test = build_dataset(t.locations, CONFIG, PERIODS)
    return stage(train.select(*COLUMNS), "train"), stage(test.select(*COLUMNS), "test")


def train_set(t: Inputs):
    return stage(build_dataset(t.locations, CONFIG, PERIODS, halves=[0])[0].select(*COLUMNS), "train")


def scores(model, table):
    return models.scored(model, table).select(
        "user1", "user2", "label", F.col("prediction").cast("int").alias("prediction"), "score")


def baseline(t: Inputs):
    train, test = both_sets(t)
    return scores(models.fit_baseline(train), test).withColumn("score", F.round("score", 4))


def two_level_sql(select: str) -> str:
    """On one 0/1 feature with balanced classes the fit has a closed form: the share of class 1 at each value."""
    sets = ",\n".join(f"""{name} AS (SELECT user1, user2, x, CAST(m IS NOT NULL AS BIGINT) AS label FROM
 (SELECT user1, user2, CAST(count(DISTINCT spatial_bin) >= 2 AS BIGINT) AS x FROM c{first} GROUP BY ALL)
 LEFT JOIN (SELECT DISTINCT user1, user2, 1 AS m FROM c{first + 1}) USING (user1, user2))"""
                       for name, first in (("train_", 1), ("test_", 2)))
    return sql(select, sets + """,
rates AS (SELECT x, count(*) FILTER (label = 1) / (SELECT count(*) FILTER (label = 1) FROM train_)::DOUBLE AS r1,
 count(*) FILTER (label = 0) / (SELECT count(*) FILTER (label = 0) FROM train_)::DOUBLE AS r0 FROM train_ GROUP BY 1),
scored_ AS (SELECT user1, user2, label, CAST(r1 > r0 AS BIGINT) AS prediction, r1 / (r1 + r0) AS score FROM test_ JOIN rates USING (x)),
points_ AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
 row_number() OVER w AS place FROM (SELECT score, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label = 0)::DOUBLE AS neg
 FROM scored_ GROUP BY 1) WINDOW w AS (ORDER BY score DESC))""")


def forest_model(table):
    return models.fit_forest(table, CORE_FEATURES)


def forest(t: Inputs):
    train, test = both_sets(t)
    return scores(forest_model(train), test)


def forest_checks(t: Inputs):
    """What holds for every forest: a score for each pair of the test set, from 0 to 1, and the class it says."""
    return forest(t).select("user1", "user2", "label", F.col("score").between(0, 1).alias("in_range"),
                            (F.col("prediction") == (F.col("score") > 0.5).cast("int")).alias("by_score"))


def importance_checks(t: Inputs):
    """Importances are one for each feature, not negative, 1 together."""
    return forest_importances(t).agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
                                     (F.min("importance") >= 0).alias("positive"))


def scaled_forest(t: Inputs):
    train, test = both_sets(t)
    return scores(models.fit_forest(train, CORE_FEATURES, scaled=True), test)


def search(t: Inputs):
    """Mean ROC AUC of every drawn setting, fitted on all pairs of two folds, over all pairs of the held-out one."""
    return t.spark.createDataFrame(models.search_forest(train_set(t), CORE_FEATURES), "max_features int, impurity string, auc double")


def best(t: Inputs):
    """The best setting of the search and its AUC on the test set."""
    found = models.best_forest(*both_sets(t), CORE_FEATURES)
    return t.spark.createDataFrame([found], "max_features int, impurity string, auc double, test_auc double")


def two_fold(t: Inputs):
    return models.two_fold(*both_sets(t), forest_model)


def fold_report(t: Inputs):
    return models.fold_report(*models.out_of_fold(*both_sets(t), forest_model), CORE_FEATURES)


def fold_totals(t: Inputs):
    """Pairs by fold, label and prediction of the baseline."""
    predicted, _ = models.out_of_fold(*both_sets(t), models.fit_baseline)
    return predicted.groupBy("fold", "label").agg(F.count("*").alias("rows"))


def forest_importances(t: Inputs):
    return models.importances(forest_model(train_set(t)), CORE_FEATURES, t.spark)


def areas(t: Inputs):
    """Areas by Spark's evaluator next to the exact ones."""
    train, test = both_sets(t)
    result = stage(models.scored(models.fit_baseline(train), test).select("label", "probability", "score"), "scored")
    exact = metrics.roc_auc(result).withColumnRenamed("auc", "exact_roc")
    return exact.withColumns({"evaluator_roc": F.lit(metrics.area_under(result)),
                              "evaluator_pr": F.lit(metrics.area_under(result, "areaUnderPR")),
                              "average_precision": metrics.average_precision(result).scalar()})


def rule(t: Inputs, first: int = 1):
    """Pairs of a period with the label of the next, scored by co-occurrences and cells."""
    labelled = labelled_places(t.met_over(first, first + 1), PERIODS[first - 1], PERIODS[first])
    score = F.round(F.col("num_coocs") + F.col("unique_coocs") / 100, 2)
    return labelled.select("user1", "user2", "label", score.alias("score"),
                           (F.col("num_coocs") >= 3).cast("int").alias("prediction"))


def rule_sql(first: int = 1, name: str = "rule") -> str:
    return f"""{name} AS (SELECT user1, user2, round(n + u / 100.0::DOUBLE, 2) AS score, CAST(n >= 3 AS BIGINT) AS prediction,
  CAST(m IS NOT NULL AS BIGINT) AS label FROM (SELECT user1, user2, count(*) AS n, count(DISTINCT spatial_bin) AS u
  FROM c{first} GROUP BY ALL) LEFT JOIN (SELECT DISTINCT user1, user2, 1 AS m FROM c{first + 1}) USING (user1, user2)),
pts_{name} AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (
  SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {name} GROUP BY 1)
  WINDOW w AS (ORDER BY score DESC))"""


CELLS_SQL = """(SELECT count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp,
 count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn, count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS tn FROM rule)"""

# Interpolation: of the segments that contain a grid point, the highest value.
GRID_SQL = """SELECT step, max(CASE WHEN f1 > f0 THEN t0 + least(greatest((step / 99.0::DOUBLE - f0) / (f1 - f0), 0), 1) * (t1 - t0)
  ELSE t1 END) AS tpr FROM (SELECT fp / n AS f1, (fp - neg) / n AS f0, tp / p AS t1, (tp - pos) / p AS t0 FROM pts_{name})
  JOIN (SELECT range AS step FROM range(100)) ON step >= f0 * 99 - 1e-9 AND step <= f1 * 99 + 1e-9 GROUP BY 1"""

QUERIES = {
    "k1_baseline": Query(baseline, two_level_sql("SELECT user1, user2, label, prediction, round(score, 4) + 0.0 AS score FROM scored_")),
    "k2_forest": Query(forest),
    "k2_forest_checks": Query(forest_checks, sql(
        """SELECT user1, user2, CAST(EXISTS (SELECT 1 FROM c3 n WHERE n.user1 = c.user1 AND n.user2 = c.user2) AS BIGINT) AS label,
 true AS in_range, true AS by_score FROM (SELECT DISTINCT user1, user2 FROM c2) c""")),
    "k3_search": Query(search),
    "k3_best": Query(best),
    "k4_two_fold": Query(two_fold),
    "k4_fold_report": Query(fold_report),
    "k4_fold_totals": Query(fold_totals, sql(" UNION ALL ".join(
        f"""SELECT CAST({fold} AS BIGINT) AS fold, label, count(*) AS rows FROM (SELECT user1, user2,
 CAST(EXISTS (SELECT 1 FROM c{period + 1} n WHERE n.user1 = c.user1 AND n.user2 = c.user2) AS BIGINT) AS label
 FROM (SELECT DISTINCT user1, user2 FROM c{period}) c) GROUP BY ALL""" for fold, period in ((0, 2), (1, 1))))),
    "k5_roc_curve": Query(lambda t: metrics.roc_curve(rule(t)), sql(
        f"SELECT score, {r6('fp / n')} AS fpr, {r6('tp / p')} AS tpr FROM pts_rule", rule_sql())),
    "k5_roc_auc": Query(lambda t: metrics.roc_auc(rule(t)), sql(
        f"SELECT {r6('sum(neg * (tp - pos / 2)) / (any_value(p)::DOUBLE * any_value(n))')} AS auc FROM pts_rule", rule_sql())),
    "k5_mean_roc": Query(
        lambda t: metrics.mean_roc([metrics.roc_at(rule(t, 1)), metrics.roc_at(rule(t, 2))]), sql(
        f"""SELECT {r6('step / 99.0')} AS fpr, CASE WHEN step = 99 THEN 1.0::DOUBLE ELSE {r6('avg(tpr)')} END AS tpr
 FROM (({GRID_SQL.format(name='rule')}) UNION ALL ({GRID_SQL.format(name='other')})) GROUP BY step""",
        rule_sql() + ",\n" + rule_sql(2, "other"))),
    "k6_average_precision": Query(lambda t: metrics.average_precision(rule(t)), sql(
        f"SELECT {r6('sum(pos / p * tp / (tp + fp))')} AS average_precision FROM pts_rule", rule_sql())),
    "k6_areas": Query(areas, two_level_sql(f"""SELECT {r6('sum(neg * (tp - pos / 2)) / any_value(p * n)')} AS exact_roc,
 {r6('sum(neg * (tp - pos / 2)) / any_value(p * n)')} AS evaluator_roc,
 {r6('sum(pos / p * tp / (tp + fp))')} AS average_precision,
 {r6("sum(pos / p * (tp / (tp + fp) + CASE WHEN place = 1 THEN tp / (tp + fp) ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2)")} AS evaluator_pr
 FROM points_""")),
    "k7_confusion": Query(lambda t: metrics.confusion(rule(t)), sql(
        "SELECT label, prediction, count(*) AS rows FROM rule GROUP BY ALL", rule_sql())),
    "k8_per_class": Query(lambda t: metrics.per_class(rule(t)), sql(
        f"""SELECT CAST(0 AS BIGINT) AS label, {r6('tn / (tn + fn)')} AS precision, {r6('tn / (tn + fp)')} AS recall,
 {r6('2 * tn / (2 * tn + fn + fp)')} AS f1 FROM {CELLS_SQL} UNION ALL
 SELECT 1, {r6('tp / (tp + fp)')}, {r6('tp / (tp + fn)')}, {r6('2 * tp / (2 * tp + fp + fn)')} FROM {CELLS_SQL}""", rule_sql())),
    "k9_matthews": Query(lambda t: metrics.matthews(rule(t)), sql(
        f"""SELECT {r6('(tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn))')} AS mcc
 FROM {CELLS_SQL}""", rule_sql())),
    "k10_importances": Query(forest_importances),
    "k10_importance_checks": Query(importance_checks, f"SELECT CAST({len(CORE_FEATURES)} AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, true AS positive"),
    "k12_scaled_forest": Query(scaled_forest),
}
