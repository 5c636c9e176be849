"""Incomes: the generator, and the recovery of known parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import incomes as I


def test_quantiles_of_the_normal(spark):
    p = [0.0001, 0.01, 0.02425, 0.2, 0.5, 0.8, 0.97575, 0.99, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(S.normal_quantile(F.col("p"))).collect()]
    assert np.allclose(I.normal_quantiles(np.array(p)), got, rtol=1e-9)


def test_generator_stays_within_its_bounds():
    x = I.generated(np.array([[300_000.0, 90_000.0, 100_000.0, 420_000.0], [1.0, 0.0, 5.0, 5.0]]))
    assert x.shape == (2, 50) and x[0].min() >= 100_000 and x[0].max() <= 420_000 and (x[1] == 5).all()


def test_known_parameters_are_recovered(spark):
    known = {"a": (300_000.0, 90_000.0, 60_000.0, 600_000.0), "b": (150_000.0, 30_000.0, 50_000.0, 260_000.0)}
    rows = [(d, float(v) / 12, 2.0) for d, p in known.items() for v in I.generated(np.array([p]))[0]]
    df = spark.createDataFrame([*rows, ("c", -1.0, 1.0)], "domain string, income double, w double")
    targets = I.survey_stats(df, ["domain"], "income", "w")
    fits = {r["domain"]: r for r in I.fitted(targets, "domain").collect()}
    assert fits.keys() == {"a", "b"}
    for d, p in known.items():
        assert fits[d]["misfit"] < 2e-4 and fits[d]["worst"] < 0.03 and fits[d]["mean"] == pytest.approx(p[0], rel=0.05)
    again = {r["domain"]: r for r in I.fitted(targets.repartition(3), "domain").collect()}
    assert again == fits
