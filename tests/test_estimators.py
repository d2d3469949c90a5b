"""Estimators where a regressor can't be told from the effects."""

from __future__ import annotations

import numpy as np
import pytest

from loomspan.operators import estimators as E


def _panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        for t in range(6):
            z, noise = map(float, rng.normal(size=2))
            x = 0.8 * z + noise + c
            rows.append((c, t, 2.0 * x + t + noise, x, z, 25.0, 2.0 * c + 0.1 * t))
    return spark.createDataFrame(rows, "c long, t long, y double, x double, z double, same double, both double")


def test_iv_leaves_out_what_the_effects_determine(spark):
    p = _panel(spark)
    plain, strength = E.iv(p, "y", "x", "z", [], ["c", "t"], "c")
    fit, first = E.iv(p, "y", "x", "z", ["same", "both"], ["c", "t"], "c")
    assert fit.names == ["x", "same", "both"] and np.isnan(fit.beta[1:]).all() and np.isnan(fit.se[1:]).all()
    assert (fit.beta[0], fit.se[0], first) == pytest.approx((plain.beta[0], plain.se[0], strength))
    with pytest.raises(ValueError, match="same does not vary"):
        E.iv(p, "y", "x", "same", [], ["c", "t"], "c")
