import numpy as np
import pytest

from massloom.operators import digest, learning
from massloom.plans.registry import QUERIES
from massloom.plans.protein_queries import _featured

from test_queries import DATA


def test_the_fit_has_no_gradient_left(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.3] + rng.normal(size=400) > 0.2).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v), i) for i, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, label double, i int")
    rows = sorted(learning.rescore(df, ["a", "b", "c"], "label", penalty=2.0).collect(), key=lambda r: r.i)
    p = np.array([r.probability for r in rows])
    design = np.column_stack((x, np.ones(400)))
    # the logit is linear in the features: its coefficients are those of the model
    w = np.linalg.lstsq(design, np.log(p / (1 - p)), rcond=None)[0]
    assert np.abs(design @ w - np.log(p / (1 - p))).max() < 1e-8
    gradient = design.T @ (p - y) + np.append(w[:3], 0) / 2.0
    assert np.abs(gradient).max() < 0.05


def test_ten_features(spark):
    rows, names = _featured(spark, DATA)
    assert len(names) == 10 and set(names) <= set(rows.columns)
    assert rows.count() == QUERIES["rescore_features"](spark, DATA).count()


@pytest.mark.parametrize(("rules", "most"), [({"~": "M"}, 1), ({"~": "M", "!": "NQ"}, 2), ({"~": "MN", "!": "NQ", "#": "K"}, 3)])
def test_modified_forms_are_those_of_plain_python(spark, rules, most):
    peptides = ["MNMQK", "AAAA", "M", "NNNNKM", "", None]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(peptides)], "peptide string, i int")
    got = sorted((r.i, r.modified, r.n_modifications) for r in digest.modify(df, rules, most).collect())
    assert got == sorted((i, m, n) for i, p in enumerate(peptides) if p for m, n in digest.modified_forms(p, rules, most))
