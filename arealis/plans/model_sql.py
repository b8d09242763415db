"""SQL of least squares with HC3 errors, as lists of common table expressions.

Normal equations of centred, scaled regressors are inverted by Gauss-Jordan steps in a recursive expression; nothing
of the library's own algebra is used, so that the two can be compared.
"""

from __future__ import annotations

_TERMS = 200


def two_sided_p(z: str) -> str:
    """Two-sided p of a normal score by the power series of the error function."""
    x = f"greatest(abs({z}) / sqrt(2), 1e-300)"
    series = (f"list_sum(list_transform(range(0, {_TERMS}), lambda n: exp(n * ln(2 * pow({x}, 2)) + ln({x}) - pow({x}, 2) "
              f"- (n + 1) * ln(2) - lgamma(n + 1.5) + 0.5 * ln(pi()))))")
    return f"(case when {x} > 6 then 0 else greatest(0, 1 - 2 / sqrt(pi()) * {series}) end)"


def ols(tag: str, source: str, y: str, xs: list[str] | tuple[str, ...], where: str = "true") -> str:
    """CTEs up to ``{tag}`` (term, coef, se, p, n, r2, adj_r2), for rows of ``source`` that have all values."""
    k = len(xs)
    present = " and ".join(f"{c} is not null" for c in (y, *xs))
    each = range(1, k + 1)
    unit = lambda i: ", ".join("1.0" if i == j else "0.0" for j in each)
    gram = ", ".join(f"[{', '.join([*(f'sum(z[{i}] * z[{j}])' for j in each), unit(i)])}]" for i in each)
    return f"""
{tag}_b as (select {y}::double as y, [{', '.join(xs)}]::double[] as x from {source} where {present} and {where}),
{tag}_m as (select count(*) as n, avg(y) as my, [{', '.join(f'avg(x[{i}])' for i in each)}] as m, [{', '.join(f'stddev_pop(x[{i}])' for i in each)}] as s from {tag}_b),
{tag}_z as (select y - my as y, [{', '.join(f'(x[{i}] - m[{i}]) / s[{i}]' for i in each)}] as z from {tag}_b, {tag}_m),
{tag}_g as (select [{gram}]::double[][] as a, [{', '.join(f'sum(z[{i}] * y)' for i in each)}]::double[] as c, sum(y * y) as syy from {tag}_z),
{tag}_j as (select 0 as s, a from {tag}_g union all
  select s + 1, list_transform(a, lambda r, i: case when i = s + 1 then list_transform(r, lambda v: v / a[s + 1][s + 1])
    else list_transform(r, lambda v, j: v - r[s + 1] * a[s + 1][j] / a[s + 1][s + 1]) end) from {tag}_j where s < {k}),
{tag}_i as (select list_transform(a, lambda r: r[{k + 1}:]) as inv from {tag}_j where s = {k}),
{tag}_c as (select inv, c, syy, list_transform(inv, lambda r: list_dot_product(r, c)) as beta from {tag}_i, {tag}_g),
{tag}_w as (select list_transform(inv, lambda r: list_dot_product(r, z)) as h, z, y, beta from {tag}_z, {tag}_c),
{tag}_u as (select h, pow((y - list_dot_product(z, beta)) / greatest(1e-12, 1 - 1.0 / n - list_dot_product(z, h)), 2) as u from {tag}_w, {tag}_m),
{tag}_v as (select [sum(u * pow(1.0 / n - ({' + '.join(f'm[{i}] / s[{i}] * h[{i}]' for i in each)}), 2)), {', '.join(f'sum(u * h[{i}] * h[{i}])' for i in each)}] as v
  from {tag}_u, {tag}_m),
{tag}_t as (select n, list_dot_product(beta, c) / syy as r2, unnest(['Intercept', {', '.join(f"'{c}'" for c in xs)}]) as term,
  unnest([my - ({' + '.join(f'beta[{i}] * m[{i}] / s[{i}]' for i in each)}), {', '.join(f'beta[{i}] / s[{i}]' for i in each)}]) as coef,
  unnest([sqrt(v[1]), {', '.join(f'sqrt(v[{i + 1}]) / s[{i}]' for i in each)}]) as se from {tag}_m, {tag}_c, {tag}_v),
{tag} as (select term, coef, se, {two_sided_p('coef / se')} as p, n, r2, 1 - (1 - r2) * (n - 1) / (n - {k + 1}) as adj_r2 from {tag}_t)"""


def component(tag: str, source: str, key: str, columns: list[str] | tuple[str, ...], steps: int = 4000) -> str:
    """CTEs up to ``{tag}`` (key, pca1): scores of complete rows on the leading eigenvector of the correlations."""
    k = range(1, len(columns) + 1)
    present = " and ".join(f"{c} is not null" for c in columns)
    rows = ", ".join(f"[{', '.join(f'corr(x[{i}], x[{j}])' if i != j else '1.0' for j in k)}]" for i in k)
    return f"""
{tag}_b as (select {key}, [{', '.join(columns)}]::double[] as x from {source} where {present}),
{tag}_m as (select [{', '.join(f'avg(x[{i}])' for i in k)}] as m, [{', '.join(f'stddev_pop(x[{i}])' for i in k)}] as s, [{rows}]::double[][] as c from {tag}_b),
{tag}_p as (select 0 as i, [{', '.join(f'{1 - 0.03 * j}' for j in k)}]::double[] as v union all
  select i + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) from (
    select i, list_transform(c, lambda r: list_dot_product(r, v)) as w from {tag}_p, {tag}_m where i < {steps})),
{tag}_l as (select case when list_sum(v) < 0 then list_transform(v, lambda x: -x) else v end as l from {tag}_p where i = {steps}),
{tag} as (select {key}, list_dot_product([{', '.join(f'(x[{i}] - m[{i}]) / s[{i}]' for i in k)}], l) as pca1 from {tag}_b, {tag}_m, {tag}_l)"""
