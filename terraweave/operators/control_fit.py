"""Transformations fitted to control points: similarity, affine, polynomials and thin-plate splines, with checks and a choice among them.

Control points are few (survey marks of one map), so a fit runs on the driver
over at most MOST_POINTS of them; what is transformed are tables of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control points of one fit; a table with more is no list of control points and is refused.
MOST_POINTS = 5_000
KINDS = ("helmert", "affine", "poly2", "poly3", "spline")
LEAST = {"helmert": 2, "affine": 3, "poly2": 6, "poly3": 10, "spline": 4}


def _terms(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    return np.column_stack([x**i * y**j for total in range(degree + 1) for i in range(total, -1, -1) for j in [total - i]])


@dataclass
class Fit:
    """A fitted transformation; coordinates are taken about ``centre`` over ``scale`` before they enter it."""

    kind: str
    centre: np.ndarray
    scale: float
    coefficients: np.ndarray
    knots: np.ndarray | None = None

    def apply(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = (x - self.centre[0]) / self.scale, (y - self.centre[1]) / self.scale
        if self.kind == "helmert":
            a, b, tx, ty = self.coefficients
            return a * u - b * v + tx, b * u + a * v + ty
        if self.kind == "spline":
            d = np.hypot(u[:, None] - self.knots[None, :, 0], v[:, None] - self.knots[None, :, 1])
            basis = np.hstack([_bent(d), _terms(u, v, 1)])
        else:
            basis = _terms(u, v, {"affine": 1, "poly2": 2, "poly3": 3}[self.kind])
        out = basis @ self.coefficients
        return out[:, 0], out[:, 1]

    def parameters(self) -> dict[str, float]:
        """Scale, rotation in degrees, shear in degrees and shift; of the linear part where the fit bends."""
        x, y = self.centre
        at = np.array([[x, y], [x + 1, y], [x, y + 1]], float)
        p = np.column_stack(self.apply(at[:, 0], at[:, 1]))
        along, across = p[1] - p[0], p[2] - p[0]
        turn = float(np.degrees(np.arctan2(along[1], along[0])))
        shear = float(np.degrees(np.arctan2(across[1], across[0]))) - turn - 90
        sx, sy = float(np.hypot(*along)), float(np.hypot(*across))
        return {"scale_x": sx, "scale_y": sy, "scale_ppm": (sx - 1) * 1e6, "rotation": turn, "shear": (shear + 180) % 360 - 180, "shift_x": float(p[0, 0] - x), "shift_y": float(p[0, 1] - y)}


def _bent(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(d > 0, d * d * np.log(d), 0.0)


def fitted(kind: str, source: np.ndarray, target: np.ndarray, sigma: np.ndarray | None = None) -> Fit:
    """The transformation of a kind that fits weighted points best; too few points are an error."""
    n = len(source)
    if n < LEAST[kind]:
        raise ValueError(f"{kind} needs {LEAST[kind]} points or more, not {n}")
    weight = 1 / np.maximum(np.ones(n) if sigma is None else sigma, 1e-6)
    centre = source.mean(0)
    scale = max(float(np.abs(source - centre).max()), 1e-9)
    u, v = ((source - centre) / scale).T
    if kind == "helmert":
        zero, one = np.zeros(n), np.ones(n)
        rows = np.vstack([np.column_stack([u, -v, one, zero]), np.column_stack([v, u, zero, one])])
        w = np.append(weight, weight)
        found = np.linalg.lstsq(rows * w[:, None], np.append(target[:, 0], target[:, 1]) * w, rcond=None)[0]
        return Fit(kind, centre, scale, found)
    if kind == "spline":
        d = np.hypot(u[:, None] - u[None], v[:, None] - v[None])
        plain = _terms(u, v, 1)
        system = np.block([[_bent(d), plain], [plain.T, np.zeros((3, 3))]])
        found = np.linalg.lstsq(system, np.vstack([target, np.zeros((3, 2))]), rcond=None)[0]
        return Fit(kind, centre, scale, found, np.column_stack([u, v]))
    basis = _terms(u, v, {"affine": 1, "poly2": 2, "poly3": 3}[kind])
    return Fit(kind, centre, scale, np.linalg.lstsq(basis * weight[:, None], target * weight[:, None], rcond=None)[0])


def residuals(fit: Fit, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.hypot(*(np.column_stack(fit.apply(source[:, 0], source[:, 1])) - target).T)


def left_out_error(kind: str, source: np.ndarray, target: np.ndarray, sigma: np.ndarray | None = None) -> float:
    """Root mean square error of each point under the fit of all others."""
    errors = []
    for k in range(len(source)):
        rest = np.arange(len(source)) != k
        fit = fitted(kind, source[rest], target[rest], None if sigma is None else sigma[rest])
        errors.append(residuals(fit, source[k : k + 1], target[k : k + 1])[0])
    return float(np.sqrt(np.mean(np.square(errors))))


def snooped(source: np.ndarray, target: np.ndarray, kind: str = "affine", limit: float = 3.5, floor: float = 0.05) -> list[int]:
    """Positions of blunders: one after the other the worst point whose error under the fit of the others stands out, until none does."""
    left, out = list(range(len(source))), []
    while len(left) > LEAST[kind] + 1:
        errors = []
        for k in left:
            rest = [i for i in left if i != k]
            errors.append(residuals(fitted(kind, source[rest], target[rest]), source[[k]], target[[k]])[0])
        errors = np.array(errors)
        scale = max(1.4826 * float(np.median(errors)), floor)
        worst = int(np.argmax(errors))
        if errors[worst] <= limit * scale:
            break
        out.append(left.pop(worst))
    return out


def chosen(source: np.ndarray, target: np.ndarray, sigma: np.ndarray | None = None, gain: float = 0.15) -> tuple[Fit, dict[str, float]]:
    """The simplest kind that no richer one beats by more than ``gain`` in left-out error, and the errors of all that can be fitted."""
    errors = {k: left_out_error(k, source, target, sigma) for k in KINDS if len(source) > LEAST[k]}
    if not errors:
        raise ValueError(f"{len(source)} control points are too few")
    best = None
    for kind, error in errors.items():
        if best is None or error < errors[best] * (1 - gain) and errors[best] > 1e-9:
            best = kind
    return fitted(best, source, target, sigma), errors


def control_arrays(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source, target and deviation of the control points of a table, in the order of their ids."""
    rows = points.dropna(subset=["source_x", "source_y", "target_x", "target_y"]).orderBy("gcp_id", "source_x", "source_y").limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} control points")
    take = lambda *c: np.array([[r[k] for k in c] for r in rows], float).reshape(-1, len(c))
    sigma = np.array([1.0 if r["sigma_m"] is None else r["sigma_m"] for r in rows], float)
    return take("source_x", "source_y"), take("target_x", "target_y"), sigma


def warped(df: DataFrame, fit: Fit, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with to_x and to_y, its points under a fit, in Arrow batches; null for null."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (x, y))
            moved = fit.apply(u, v)
            known = np.isfinite(u) & np.isfinite(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m, mask=~known) for m in moved]], names=[*batch.schema.names, "to_x", "to_y"])

    return df.mapInArrow(run, f"{fields}, to_x double, to_y double")


def fit_report(points: DataFrame) -> DataFrame:
    """(kind, left_out, chosen) of a table of control points after its blunders are taken out."""
    source, target, sigma = control_arrays(points)
    bad = snooped(source, target)
    keep = np.setdiff1d(np.arange(len(source)), bad)
    fit, errors = chosen(source[keep], target[keep], sigma[keep])
    rows = [(k, float(e), k == fit.kind, len(bad)) for k, e in errors.items()]
    return points.sparkSession.createDataFrame(rows, "kind string, left_out double, chosen boolean, blunders bigint").select("*", F.lit(len(keep)).cast("bigint").alias("points"))
