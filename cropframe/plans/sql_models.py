"""DuckDB twins of the linear models: normal equations and coordinate descent in SQL."""

from __future__ import annotations

from collections.abc import Sequence

#: Sweeps of the recursive coordinate descent; the scaled matrices here converge in far fewer.
SWEEPS = 120


def placed(src: str, key: str, by: str = "crop", seed: int = 42, out: str = "placed") -> str:
    """CTE ``out``: rows of ``src`` with their place in the seeded order of their group, and its size."""
    return (f"{out} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws('|', '{seed}', {key}))) AS pos,\n"
            f"  count(*) OVER (PARTITION BY {by}) AS group_n FROM {src})")


#: Fold of a placed row: the first group_n % 5 folds are one row longer.
FOLD = ("CASE WHEN pos <= (group_n % 5) * (group_n // 5 + 1) THEN (pos - 1) // (group_n // 5 + 1) "
        "ELSE group_n % 5 + (pos - 1 - (group_n % 5) * (group_n // 5 + 1)) // greatest(group_n // 5, 1) END")
IS_TEST = "pos <= ceil(0.2 * group_n)"


def scaled(src: str, by: str, features: Sequence[str], target: str, out: str) -> str:
    """CTEs up to ``out``: by, n, my, m, s, g (correlation-scaled matrix), c (with the target) of each group."""
    p = range(len(features))
    f = list(features)
    size = [f"greatest(abs(avg({f[i]})), 1)" for i in p]
    flat = [f"stddev_pop({f[i]}) <= 1e-12 * {size[i]}" for i in p]
    s = [f"CASE WHEN {flat[i]} THEN 1.0 ELSE stddev_pop({f[i]}) END" for i in p]
    row = lambda i: "[" + ", ".join(
        f"CASE WHEN {flat[i]} OR {flat[j]} THEN 0.0 ELSE covar_pop({f[i]}, {f[j]}) / (stddev_pop({f[i]}) * stddev_pop({f[j]})) END"
        for j in p) + "]"
    c = ", ".join(f"CASE WHEN {flat[i]} THEN 0.0 ELSE covar_pop({f[i]}, {target}) / stddev_pop({f[i]}) END" for i in p)
    return (f"{out} AS (SELECT {by}, count(*) AS n, avg({target}) AS my, [{', '.join(f'avg({x})' for x in f)}] AS m, "
            f"[{', '.join(s)}] AS s,\n  [{', '.join(row(i) for i in p)}] AS g, [{c}] AS c FROM {src} GROUP BY {by})")


def least_squares(src: str, by: str, p: int, out: str) -> str:
    """CTEs up to ``out``: by, n, my, m, s, w from ``scaled`` rows, by pivots in order; aliased features get 0."""
    parts = [f"{out}_0 AS (SELECT {by}, n, my, m, s, list_transform(g, lambda r, i: list_append(r, c[i])) AS a, "
             f"CAST([] AS BOOLEAN[]) AS used FROM {src})"]
    for k in range(1, p + 1):
        parts.append(
            f"{out}_{k} AS (SELECT {by}, n, my, m, s, CASE WHEN a[{k}][{k}] <= 1e-9 THEN a ELSE list_transform(a, lambda r, i: "
            f"CASE WHEN i = {k} THEN list_transform(r, lambda v: v / a[{k}][{k}]) "
            f"ELSE list_transform(r, lambda v, j: v - r[{k}] * a[{k}][j] / a[{k}][{k}]) END) END AS a, "
            f"list_append(used, a[{k}][{k}] > 1e-9) AS used FROM {out}_{k - 1})")
    w = ", ".join(f"CASE WHEN used[{i}] THEN a[{i}][{p + 1}] ELSE 0 END" for i in range(1, p + 1))
    parts.append(f"{out} AS (SELECT {by}, n, my, m, s, [{w}] AS w FROM {out}_{p})")
    return ",\n".join(parts)


def elastic_net(src: str, by: str, p: int, out: str, l1: str, l2: str, extra: str = "") -> str:
    """CTEs up to ``out``: by, extra, n, my, m, s, w; one coordinate a step. The WITH needs RECURSIVE."""
    keep = f"{by}, {extra}, n, my, m, s" if extra else f"{by}, n, my, m, s"
    zeros = "[" + ", ".join(["CAST(0 AS DOUBLE)"] * p) + "]"
    rho = f"(c[k % {p} + 1] - list_inner_product(g[k % {p} + 1], w) + g[k % {p} + 1][k % {p} + 1] * w[k % {p} + 1])"
    new = (f"CASE WHEN g[k % {p} + 1][k % {p} + 1] = 0 THEN 0 ELSE sign({rho}) * greatest(abs({rho}) - l1_, 0) "
           f"/ (g[k % {p} + 1][k % {p} + 1] + l2_) END")
    return (f"{out}_r AS (SELECT {keep}, g, c, {l1} AS l1_, {l2} AS l2_, 0 AS k, {zeros} AS w FROM {src}\n"
            f"  UNION ALL SELECT {keep}, g, c, l1_, l2_, k + 1, list_transform(w, lambda v, i: CASE WHEN i = k % {p} + 1 THEN "
            f"{new} ELSE v END) FROM {out}_r WHERE k < {SWEEPS * p}),\n"
            f"{out} AS (SELECT {keep}, w FROM {out}_r WHERE k = {SWEEPS * p})")


def predicted(features: Sequence[str], model: str = "o") -> str:
    """Prediction of a row's features by the model row ``model``."""
    return f"{model}.my + " + " + ".join(f"{model}.w[{i}] * ({x} - {model}.m[{i}]) / {model}.s[{i}]" for i, x in enumerate(features, 1))


def metrics(by: str = "crop, model_type") -> str:
    """Columns of the evaluation of rows (label, prediction)."""
    return f"""SELECT {by}, round(avg((label - prediction) ** 2), 6) AS mse, round(avg(abs(label - prediction)), 6) AS mae,
       round(avg(abs(label - prediction) / nullif(abs(label), 0)), 6) AS mape, count(*) AS n,
       round(sqrt(avg((label - prediction) ** 2)), 6) AS rmse,
       round(CASE WHEN var_samp(label) > 0 THEN 1 - sum((label - prediction) ** 2) / (var_samp(label) * (count(*) - 1)) END, 6) AS r2"""
