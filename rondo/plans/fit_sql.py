"""SQL of iterative fits: Newton steps as a recursive table expression, one row of coefficients per key and step."""

from __future__ import annotations


def _minor(m: list[list[str]], i: int, j: int) -> list[list[str]]:
    return [[v for c, v in enumerate(row) if c != j] for r, row in enumerate(m) if r != i]


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " + ".join(f"{'-' if j % 2 else ''}{v} * {_det(_minor(m, 0, j))}" for j, v in enumerate(m[0])) + ")"


def newton_sql(name: str, source: str, xs: list[str], y: str, family: str, offset: str = "0.0", key: str = "0", steps: int = 25) -> str:
    """CTE list ending in ``name``: key, n, loss and coefficients b0 (intercept), b1, ... after ``steps`` Newton steps from 0."""
    k = len(xs) + 1
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    eta = " + ".join(["o", *[f"b{i} * x{i}" for i in range(k)]])
    mean = "exp(e)" if family == "poisson" else "1 / (1 + exp(-e))"
    weight = "m" if family == "poisson" else "m * (1 - m)"
    loss = "m - y * e" if family == "poisson" else "greatest(e, 0) + ln(1 + exp(-abs(e))) - y * e"
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]
    solved = [f"b{i} + ({' + '.join(f'{chr(45) if (i + j) % 2 else str()}g{j} * {_det(_minor(h, j, i)) if k > 1 else 1}' for j in range(k))}) / {_det(h)} AS b{i}" for i in range(k)]
    bs = ", ".join(f"b{i}" for i in range(k))
    return f"""
{name}_in AS MATERIALIZED (SELECT {key} AS key, CAST({y} AS DOUBLE) AS y, CAST({offset} AS DOUBLE) AS o, 1.0::DOUBLE AS x0, {', '.join(f'CAST({x} AS DOUBLE) AS x{i + 1}' for i, x in enumerate(xs))} FROM {source}),
{name}_all AS (
  SELECT key, 0 AS step, 0::BIGINT AS n, 0.0::DOUBLE AS loss, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))} FROM (SELECT DISTINCT key FROM {name}_in)
  UNION ALL
  SELECT key, step + 1, n, loss, {', '.join(solved)} FROM (
    SELECT key, step, count(*) AS n, avg({loss}) AS loss, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(k))}, {', '.join(f'sum((y - m) * x{i}) AS g{i}' for i in range(k))},
      {', '.join(f'sum({weight} * x{i} * x{j}) AS h{i}{j}' for i, j in cells)}
    FROM (SELECT *, {mean} AS m FROM (SELECT d.*, s.step, {', '.join(f's.b{i}' for i in range(k))}, {eta} AS e FROM {name}_all s JOIN {name}_in d ON d.key IS NOT DISTINCT FROM s.key WHERE s.step < {steps})) GROUP BY key, step)),
{name} AS (SELECT key, n, loss, {bs} FROM {name}_all WHERE step = {steps})"""
