"""SQL of a ridge logistic fit by reweighted least squares, step by step as the Spark fit takes them."""

from __future__ import annotations

from collections.abc import Sequence


def _solved(source: str, size: int, keep: Sequence[str]) -> str:
    """Gauss-Jordan elimination of the list of lists `m` (size rows) of `source`, one nested select per column."""
    names = ", ".join(keep)
    for k in range(1, size + 1):
        step = f"""list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda x: x / m[{k}][{k}])
          ELSE list_transform(r, lambda x, j: x - r[{k}] * m[{k}][j] / m[{k}][{k}]) END)"""
        source = f"(SELECT {names}, {step} AS m FROM {source})"
    return source


def _matrix(size: int, penalty: Sequence[str]) -> str:
    """Means of products of the design `a` with weights `w`, plus the penalty, then the right side of `z`, then the unit matrix."""
    rows = []
    for i in range(1, size + 1):
        cells = [f"sum(w * a[{i}] * a[{j}]) / sum(w)" + (f" + {penalty[i - 1]}" if i == j else "") for j in range(1, size + 1)]
        cells.append(f"sum(w * z * a[{i}]) / sum(w)")
        cells += [f"{float(i == j)}::DOUBLE" for j in range(1, size + 1)]
        rows.append(f"[{', '.join(cells)}]")
    return f"[{', '.join(rows)}]"


def logistic_fit(rows: str, cols: Sequence[str], ridge: float | None, tol: float | None = 1e-6, most: int = 100) -> str:
    """CTEs ending in `fitted` (fit, coef, error): coefficients in the order of `cols`, then the intercept, and standard errors.

    `rows` names (fit, y, weight, cols); every `fit` is one fit. The first step
    fits the smoothed log odds of the labels with standardised features and
    label, each further one the working response, until no coefficient moves by
    `tol` or more. The ridge is scaled by the sum of the working weights. Ridge
    and tolerance that are None are the columns `ridge` and `tol` of the rows.
    """
    extra = "".join(f", {name}" for name, given in (("ridge", ridge), ("tol", tol)) if given is None)
    limit = "d.tol" if tol is None else str(tol)
    ridge = "max(ridge)" if ridge is None else str(ridge)
    p = len(cols)
    size = p + 1
    deviation = "sqrt(greatest(sum(w * z * z) / sum(w) - pow(sum(w * z) / sum(w), 2), 0))"
    first = [f"{ridge} / {deviation} * (sum(w * a[{i}] * a[{i}]) / sum(w) - pow(sum(w * a[{i}]) / sum(w), 2))" for i in range(1, size)]
    start = f"(SELECT fit, 0 AS iter, sum(w) AS total, {_matrix(size, [*first, '0'])} AS m FROM smoothed GROUP BY fit)"
    eta = " + ".join(f"f.coef[{i}] * d.a[{i}]" for i in range(1, size + 1))
    working = f"""(SELECT fit, iter, coef, weight * mu * (1 - mu) AS w, eta + (y - mu) / (mu * (1 - mu)) AS z, a{extra}
      FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (SELECT f.fit, f.iter, f.coef, d.* EXCLUDE (fit), {eta} AS eta
        FROM fitting f JOIN design d ON d.fit = f.fit WHERE f.moved >= {limit} AND f.iter < {most})))"""
    again = f"(SELECT fit, iter, coef, sum(w) AS total, {_matrix(size, [ridge] * p + ['0'])} AS m FROM {working} GROUP BY fit, iter, coef)"
    solution = f"list_transform(m, lambda r: r[{size + 1}])"
    errors = f"list_transform(m, lambda r, i: sqrt(r[{size + 1} + i] / total))"
    moved = "list_max(list_transform(range(1, len(m) + 1), lambda i: abs(m[i][len(m) + 1] - coef[i])))"
    return f"""design AS MATERIALIZED (SELECT fit, y, weight, [{", ".join(cols)}, 1.0::DOUBLE] AS a{extra} FROM {rows}),
smoothed AS (SELECT fit, weight AS w, ln(mu / (1 - mu)) AS z, a{extra} FROM (SELECT *, (weight * y + 0.5) / (weight + 1) AS mu FROM design)),
fitting AS (
  SELECT fit, iter, {solution} AS coef, {errors} AS error, 1e9::DOUBLE AS moved FROM {_solved(start, size, ["fit", "iter", "total"])}
  UNION ALL
  SELECT fit, iter + 1, {solution}, {errors}, {moved} FROM {_solved(again, size, ["fit", "iter", "coef", "total"])}),
fitted AS (SELECT fit, arg_max(coef, iter) AS coef, arg_max(error, iter) AS error FROM fitting GROUP BY fit)"""


def log_odds(coef: str, cols: Sequence[str], table: str) -> str:
    """The linear predictor of a row."""
    terms = [f"{coef}[{i}] * {table}.{c}" for i, c in enumerate(cols, 1)]
    return " + ".join([*terms, f"{coef}[{len(cols) + 1}]"])


def normal_two_sided(t: str) -> str:
    """P(|N| > |t|) by Simpson's rule over 2,000 steps of the density from 0 to |t|."""
    return f"""(1 - 2 * abs({t}) / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001),
      lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs({t}) * i / 2000, 2) / 2))))"""


def curve_steps(judged: str, name: str) -> str:
    """CTE of the steps of the curves of `judged` (fit, y, score): rates and precision at each score and before it."""
    w = "(PARTITION BY fit ORDER BY score DESC)"
    return f"""{name} AS (
  SELECT fit, fp / q AS x, tp / p AS y, tp / (tp + fp) AS prec, coalesce(lag(fp / q) OVER {w}, 0) AS x0,
    coalesce(lag(tp / p) OVER {w}, 0) AS y0, coalesce(lag(tp / (tp + fp)) OVER {w}, tp / (tp + fp)) AS prec0
  FROM (SELECT *, sum(pos) OVER {w} AS tp, sum(neg) OVER {w} AS fp, sum(pos) OVER (PARTITION BY fit) AS p, sum(neg) OVER (PARTITION BY fit) AS q
    FROM (SELECT fit, score, sum(y) AS pos, sum(1 - y) AS neg FROM {judged} GROUP BY fit, score)))"""


def dealt_folds(rows: str, id: str, label: str, k: int, seed: int) -> str:
    """`rows` with `fold`: each label's rows dealt out in hashed order."""
    h = f"('0x' || substr(md5({id} || '#{seed}'), 1, 13))::BIGINT"
    return f"(SELECT *, CAST((row_number() OVER (PARTITION BY {label} ORDER BY {h}, {id}) - 1) % {k} AS INTEGER) AS fold FROM {rows})"
