"""Pieces of the SQL equivalents."""

from ..functions import rng


def rounded(expression: str, digits: int) -> str:
    """The same arithmetic as ieee.at_scale."""
    return f"floor(({expression}) * {10.0**digits!r}::DOUBLE + 0.5) / {10.0**digits!r}::DOUBLE"


def _polynomial(x: str, coefficients) -> str:
    out = f"{float(coefficients[0])!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


_Q = "({p} - 0.5)"
_R = "(0.180625 - {p0} * {p0})".replace("{p0}", _Q)
_S = "sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1.0 - {p} END))"
_OUTER = f"CASE WHEN {_S} <= 5.0 THEN {_polynomial(f'({_S} - 1.6)', rng.MIDDLE_TOP)} / {_polynomial(f'({_S} - 1.6)', rng.MIDDLE_BELOW)} ELSE {_polynomial(f'({_S} - 5.0)', rng.FAR_TOP)} / {_polynomial(f'({_S} - 5.0)', rng.FAR_BELOW)} END"
#: Format with p.
NORMAL_INVERSE = f"(CASE WHEN abs({_Q}) <= 0.425 THEN {_Q} * {_polynomial(_R, rng.CENTRE_TOP)} / {_polynomial(_R, rng.CENTRE_BELOW)} WHEN {{p}} < 0.5 THEN -({_OUTER}) ELSE ({_OUTER}) END)"
_TAIL = f"(exp(-abs({{x}}) * abs({{x}}) / 2.0) * {_polynomial('abs({x})', rng.HART_TOP)} / {_polynomial('abs({x})', rng.HART_BELOW)})"
#: Format with x, |x| below 7.
NORMAL_CDF = f"(CASE WHEN {{x}} > 0 THEN 1.0 - {_TAIL} ELSE {_TAIL} END)"
#: Format with seed, stream, k.
UNIFORM = "(CAST(('0x' || substr(md5('{seed}:{stream}:' || {k}), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0)"

#: The points of the spatial queries: one for each (quantity, discount), as in plans.space.points().
POINTS = "pts AS (SELECT CAST(floor(l_quantity) * 1000 + floor(l_discount * 100 + 0.5) AS BIGINT) AS pid, l_quantity AS x, floor(l_discount * 100 + 0.5) * 5.0 AS y, floor(avg(l_extendedprice) * 100 + 0.5) / 100 AS z FROM lineitem GROUP BY 1, 2, 3)"
