import datetime as dt

from pyspark.sql import functions as F

from tapcast.operators.metrics import competition_score
from tapcast.operators.validation import fold, fold_sizes, out_of_fold, same_weekday_origins


def _frame(spark):
    rows = [(dt.date(2024, 1, d), d % 3, float(d), float(d + 1)) for d in range(1, 11) for _ in range(d)]
    return spark.createDataFrame(rows, "service_date date, k int, y double, p double")


def test_fold_split(spark):
    f = _frame(spark)
    tr, va = fold(f, "2024-01-06")
    assert tr.agg(F.max("service_date")).first()[0] < dt.date(2024, 1, 6)
    assert {r.service_date for r in va.select("service_date").distinct().collect()} == {dt.date(2024, 1, 6)}
    assert tr.count() == sum(range(1, 6)) and va.count() == 6


def test_fold_sizes(spark):
    out = {r.origin: r for r in fold_sizes(_frame(spark), ["2024-01-03", "2024-01-09"]).collect()}
    a = out[dt.date(2024, 1, 3)]
    assert (a.n_train, a.n_valid, a.first_train_date, a.last_train_date) == \
           (3, 3, dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert out[dt.date(2024, 1, 9)].n_train == sum(range(1, 9))


def test_same_weekday_origins():
    assert same_weekday_origins("2024-01-31") == [dt.date(2024, 1, 17), dt.date(2024, 1, 24)]
    assert same_weekday_origins("2024-01-31", k=3, first_available="2024-01-10") == \
        [dt.date(2024, 1, 17), dt.date(2024, 1, 24)]


def test_score_is_mean_of_maes(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 1.0), (3.0, 3.0, 0.0, 2.0)],
                               "in_nums double, in_pred double, out_nums double, out_pred double")
    r = competition_score(df).first()
    assert (r.mae_in, r.mae_out, r.score) == (0.5, 3.0, 1.75)


def test_out_of_fold_keys(spark):
    f = _frame(spark)

    def fp(tr, va):
        mean = tr.agg(F.avg("y")).first()[0]
        return va.withColumn("pred", F.lit(mean))
    oof = out_of_fold(f, ["2024-01-05", "2024-01-08"], fp)
    assert oof.count() == 5 + 8
    got = {r.service_date: r.pred for r in oof.select("service_date", "pred").distinct().collect()}
    assert got[dt.date(2024, 1, 5)] == sum(d * d for d in range(1, 5)) / sum(range(1, 5))
