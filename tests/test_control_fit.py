from __future__ import annotations

import numpy as np
import pytest

from terraweave.operators import control_fit as C


def points(n=30, noise=0.0, seed=11):
    rng = np.random.default_rng(seed)
    source = rng.uniform(0, 500, (n, 2))
    return source, source + [5, -3] + rng.normal(0, noise, (n, 2)) if noise else source + [5.0, -3.0]


def test_exact_fits_and_parameters():
    source, target = points()
    for kind in C.KINDS:
        assert np.sqrt((C.residuals(C.fitted(kind, source, target), source, target) ** 2).mean()) < 1e-6
    p = C.fitted("affine", source, target).parameters()
    assert abs(p["shift_x"] - 5) < 1e-9 and abs(p["rotation"]) < 1e-9 and abs(p["scale_ppm"]) < 1e-4
    turned = source @ np.array([[0.0, 2.0], [-2.0, 0.0]])
    h = C.fitted("helmert", source, turned).parameters()
    assert abs(h["rotation"] - 90) < 1e-6 and abs(h["scale_x"] - 2) < 1e-9 and abs(h["shear"]) < 1e-6
    for kind in C.KINDS:
        with pytest.raises(ValueError, match="points or more"):
            C.fitted(kind, source[: C.LEAST[kind] - 1], target[: C.LEAST[kind] - 1])


def test_blunders_are_named_and_the_simplest_is_chosen():
    source, target = points(24, 0.05)
    target[7] += [25, -18]
    assert C.snooped(source, target) == [7]
    keep = np.arange(24) != 7
    fit, errors = C.chosen(source[keep], target[keep])
    assert fit.kind in ("helmert", "affine") and errors["spline"] > 0
    assert errors["spline"] > np.sqrt((C.residuals(C.fitted("spline", source[keep], target[keep]), source[keep], target[keep]) ** 2).mean())
    bent = source + np.column_stack([1e-4 * source[:, 0] ** 2, 1e-4 * source[:, 0] * source[:, 1]])
    assert C.chosen(source, bent)[0].kind == "poly2"


def test_tables(spark):
    source, target = points(20, 0.05)
    target[3] += [40, 40]
    rows = [(f"g{k:02}", *map(float, (*s, *t)), 0.05 if k % 2 else None) for k, (s, t) in enumerate(zip(source, target))] + [("none", None, 1.0, 2.0, 3.0, 0.1)]
    df = spark.createDataFrame(rows, "gcp_id string, source_x double, source_y double, target_x double, target_y double, sigma_m double")
    report = C.fit_report(df).collect()
    assert [r.kind for r in report if r.chosen] in (["helmert"], ["affine"]) and report[0].blunders == 1 and report[0].points == 19
    moved = C.warped(df.select("gcp_id", "source_x", "source_y"), C.fitted("affine", source, source + [1.0, 2.0]), "source_x", "source_y").collect()
    by = {r.gcp_id: r for r in moved}
    assert by["none"].to_x is None and abs(by["g00"].to_x - source[0, 0] - 1) < 1e-9
