"""The normal distribution function as an SQL expression, for Spark and for DuckDB alike (neither has one)."""

from . import dist


def _polynomial(parts: list[float], x: str) -> str:
    out = f"{parts[-1]:.17e}"
    for c in parts[-2::-1]:
        out = f"({c:.17e} + {x} * {out})"
    return out


def phi(z: str) -> str:
    """SQL of the normal distribution function of a column, to about 1e-15; the approximations of dist.erfc."""
    a = f"abs({z} / sqrt(2e0))"
    ratio = lambda parts, x: f"({_polynomial(parts[0], x)} / {_polynomial(parts[1], x)})"
    near = f"1e0 - {a} * {ratio(dist._NEAR, f'({a} * {a})')}"
    mid = f"exp(-{a} * {a}) * {ratio(dist._MID, a)}"
    far = f"exp(-{a} * {a}) * (1e0 / sqrt(pi()) - {ratio(dist._FAR, f'(1e0 / ({a} * {a}))')} / ({a} * {a})) / {a}"
    tail = f"0.5e0 * CASE WHEN {a} <= 0.46875e0 THEN {near} WHEN {a} <= 4e0 THEN {mid} WHEN {a} < 26e0 THEN {far} ELSE 0e0 END"
    return f"CASE WHEN {z} > 0 THEN 1e0 - {tail} ELSE {tail} END"
