"""DuckDB SQL for results that need a little linear algebra or a special function: PCA, LASSO, p-values.

Four features are enough for explicit columns: a symmetric matrix is ten of them (b11, b12, ... b44).
"""

from __future__ import annotations

from typing import Sequence

P = 4
PAIRS = [(i, j) for i in range(1, P + 1) for j in range(i, P + 1)]


def el(name: str, i: int, j: int) -> str:
    return f"{name}{min(i, j)}{max(i, j)}"


def pca_ctes(rows: str, features: Sequence[str], threshold: float = 0.90) -> str:
    """CTEs up to ``eig`` (pc, evr, cum, v1..v4, kept): eigenpairs of the correlation matrix.

    The largest eigenpair is the limit of repeated squaring (a projector of trace 1); taking it off leaves the next.
    Signs: the largest loading of a component is positive.
    """
    sums = ", ".join(f"corr({features[i - 1]}, {features[j - 1]}) AS a{i}{j}" for i, j in PAIRS)
    out = [f"a1 AS (SELECT {sums} FROM {rows})"]
    for c in range(1, P + 1):
        trace = "(" + " + ".join(f"{1 if i == j else 2} * b{i}{j} * b{i}{j}" for i, j in PAIRS) + ")"
        square = ", ".join("(" + " + ".join(f"{el('b', i, k)} * {el('b', k, j)}" for k in range(1, P + 1)) + f") / {trace}" for i, j in PAIRS)
        out.append(f"q{c}(k, {', '.join(f'b{i}{j}' for i, j in PAIRS)}) AS (SELECT 0, {', '.join(f'a{i}{j}' for i, j in PAIRS)} FROM a{c} "
                   f"UNION ALL SELECT k + 1, {square} FROM q{c} WHERE k < 45)")
        value = " + ".join(f"{1 if i == j else 2} * a{i}{j} * b{i}{j}" for i, j in PAIRS)
        out.append(f"e{c} AS (SELECT {c} AS pc, {value} AS lam, q.* FROM q{c} q, a{c} WHERE k = 45)")
        out.append(f"a{c + 1} AS (SELECT {', '.join(f'a{i}{j} - lam * b{i}{j} AS a{i}{j}' for i, j in PAIRS)} FROM a{c}, e{c})")
    top = "greatest(" + ", ".join(f"b{i}{i}" for i in range(1, P + 1)) + ")"
    loads = ", ".join("CASE " + " ".join(f"WHEN b{m}{m} = {top} THEN {el('b', i, m)} / sqrt(b{m}{m})" for m in range(1, P + 1)) + f" END AS v{i}" for i in range(1, P + 1))
    out.append("every AS (" + " UNION ALL ".join(f"SELECT * FROM e{c}" for c in range(1, P + 1)) + ")")
    out.append(f"eig0 AS (SELECT pc, lam / {P} AS evr, sum(lam) OVER (ORDER BY pc) / {P} AS cum, {loads} FROM every)")
    out.append(f"eig AS (SELECT * FROM eig0 WHERE cum - evr < {threshold})")
    return ",\n".join(out)


def loadings(features: Sequence[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, pc, v{i} AS loading FROM eig" for i, f in enumerate(features, 1))


def scores(rows: str, features: Sequence[str], components: int) -> str:
    """row_id, PC1.. of every row."""
    z = [f"(l.{f} - s.m{i}) / s.d{i}" for i, f in enumerate(features, 1)]
    stats = ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS d{i}" for i, f in enumerate(features, 1))
    cols = ", ".join("(" + " + ".join(f"{z[i - 1]} * g{c}.v{i}" for i in range(1, P + 1)) + f") AS PC{c}" for c in range(1, components + 1))
    joins = "".join(f", (SELECT * FROM eig WHERE pc = {c}) g{c}" for c in range(1, components + 1))
    return f"SELECT l.row_id, {cols} FROM {rows} l, (SELECT {stats} FROM {rows}) s{joins}"


def _sweeps(source: str, keys: Sequence[str], sweeps: int, name: str) -> str:
    """Coordinate descent from 0 for every row of ``source`` (keys, g.., c1..c4, alpha): CTE ``name`` (keys, w1..w4)."""
    given = [*keys, *[f"g{i}{j}" for i, j in PAIRS], *[f"c{i}" for i in range(1, P + 1)], "alpha"]
    inner = f"SELECT k, {', '.join(given)}, w1, w2, w3, w4 FROM {name}_r WHERE k < {sweeps}"
    for i in range(1, P + 1):
        rho = f"(c{i}" + "".join(f" - {el('g', i, j)} * w{j}" for j in range(1, P + 1) if j != i) + ")"
        new = f"CASE WHEN g{i}{i} > 0 THEN sign({rho}) * greatest(abs({rho}) - alpha, 0) / g{i}{i} ELSE 0 END"
        inner = f"SELECT * REPLACE ({new} AS w{i}) FROM ({inner})"
    return (f"{name}_r(k, {', '.join(given)}, w1, w2, w3, w4) AS (SELECT 0, {', '.join(given)}, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM {source} "
            f"UNION ALL SELECT k + 1, {', '.join(given)}, w1, w2, w3, w4 FROM ({inner})),\n"
            f"{name} AS (SELECT * FROM {name}_r WHERE k = {sweeps})")


def _problem(features: Sequence[str], target: str) -> str:
    """Sums of a standardised problem with the scales d1..d4: g.., c1..c4."""
    g = [f"covar_pop({features[i - 1]}, {features[j - 1]}) / any_value(d{i} * d{j}) AS g{i}{j}" for i, j in PAIRS]
    c = [f"covar_pop({f}, {target}) / any_value(d{i}) AS c{i}" for i, f in enumerate(features, 1)]
    return ", ".join([*g, *c])


def _scales(rows: str, features: Sequence[str]) -> str:
    return "sc AS (SELECT " + ", ".join(f"stddev_pop({f}) AS d{i}" for i, f in enumerate(features, 1)) + f" FROM {rows})"


def _result(name: str, features: Sequence[str], target: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{f}' AS feature, w{i} AS w, alpha FROM {name}" for i, f in enumerate(features, 1))
    return (f"SELECT '{target}' AS target, feature, round(w, 4) AS coefficient, round(abs(w), 4) AS abs_coefficient, "
            f"rank() OVER (ORDER BY abs(w) DESC) AS rank, round(alpha, 6) AS alpha FROM ({each})")


def lasso_sql(li: str, features: Sequence[str], target: str, alpha: float) -> str:
    return f"""WITH RECURSIVE li AS ({li}), {_scales('li', features)},
pr AS (SELECT {_problem(features, target)}, {alpha}::DOUBLE AS alpha FROM li, sc),
{_sweeps('pr', [], 400, 'fit')}
{_result('fit', features, target)}"""


def lasso_cv_sql(li: str, features: Sequence[str], target: str, folds: int = 5, alphas: int = 100, eps: float = 1e-3) -> str:
    """The path's alpha with the least mean test error over contiguous folds, then the fit on all rows."""
    test = ", ".join([f"avg({f} / d{i}) AS mx{i}" for i, f in enumerate(features, 1)] + [f"avg({target}) AS my", f"var_pop({target}) AS syy"]
                     + [f"covar_pop({f} / d{i}, {target}) AS sy{i}" for i, f in enumerate(features, 1)]
                     + [f"covar_pop({features[i - 1]} / d{i}, {features[j - 1]} / d{j}) AS s{i}{j}" for i, j in PAIRS])
    train = ", ".join([f"avg({f} / d{i}) AS tx{i}" for i, f in enumerate(features, 1)] + [f"avg({target}) AS ty"])
    quad = " + ".join(f"{1 if i == j else 2} * w{i} * w{j} * s{i}{j}" for i, j in PAIRS)
    lin = " + ".join(f"w{i} * sy{i}" for i in range(1, P + 1))
    off = f"(my - ty{''.join(f' - w{i} * (mx{i} - tx{i})' for i in range(1, P + 1))})"
    return f"""WITH RECURSIVE li AS ({li}), {_scales('li', features)},
cut AS (SELECT count(*) // {folds} AS q, count(*) % {folds} AS r FROM li),
f AS (SELECT li.*, sc.*, CASE WHEN row_id < r * (q + 1) THEN row_id // (q + 1) ELSE r + (row_id - r * (q + 1)) // q END AS fold FROM li, cut, sc),
whole AS (SELECT {_problem(features, target)} FROM f),
path AS (SELECT i, greatest({', '.join(f'abs(c{i})' for i in range(1, P + 1))}) * pow({eps}, i / {float(alphas - 1)!r}) AS alpha FROM whole, range({alphas}) t(i)),
tr AS (SELECT k.k AS fold, {_problem(features, target)}, {train} FROM f, range({folds}) k(k) WHERE f.fold <> k.k GROUP BY k.k),
te AS (SELECT fold, {test} FROM f GROUP BY fold),
grid AS (SELECT tr.* EXCLUDE ({', '.join(f'tx{i}' for i in range(1, P + 1))}, ty), i, alpha FROM tr, path),
{_sweeps('grid', ['fold', 'i'], 250, 'cv')},
err AS (SELECT i, any_value(alpha) AS alpha, avg(syy - 2 * ({lin}) + {quad} + {off} * {off}) AS mse FROM cv JOIN te USING (fold) JOIN (SELECT fold, ty, {', '.join(f'tx{i}' for i in range(1, P + 1))} FROM tr) USING (fold) GROUP BY i),
best AS (SELECT alpha FROM err ORDER BY mse, i LIMIT 1),
pr AS (SELECT whole.*, alpha FROM whole, best),
{_sweeps('pr', [], 400, 'fit')}
{_result('fit', features, target)}"""


def beta_ctes(source: str, keys: Sequence[str]) -> str:
    """CTE ``pv`` (keys, p): the regularised incomplete beta I_x(a, b) of every row of ``source`` (keys, a, b, x), 0 < x < 1.

    Lentz's continued fraction, with the two arguments exchanged where that converges faster.
    """
    ks = ", ".join(keys)
    even, odd = "(m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)))", "(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)))"
    step = f"SELECT *, 1 / (1 + {even} * d) AS d1, 1 + {even} / c AS c1 FROM (SELECT * REPLACE (m + 1 AS m) FROM bc WHERE NOT done AND m < 3000)"
    step = f"SELECT *, 1 / (1 + {odd} * d1) AS d2, 1 + {odd} / c1 AS c2 FROM ({step})"
    return f"""side AS (SELECT {ks}, x >= (a + 1) / (a + b + 2) AS flip, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) AS front,
  CASE WHEN x < (a + 1) / (a + b + 2) THEN a ELSE b END AS a, CASE WHEN x < (a + 1) / (a + b + 2) THEN b ELSE a END AS b,
  CASE WHEN x < (a + 1) / (a + b + 2) THEN x ELSE 1 - x END AS x FROM {source}),
bc({ks}, flip, front, a, b, x, m, c, d, h, done) AS (
  SELECT *, 0, 1::DOUBLE, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1)), false FROM side
  UNION ALL SELECT {ks}, flip, front, a, b, x, m, c2, d2, h * d1 * c1 * d2 * c2, abs(d2 * c2 - 1) < 1e-15 FROM ({step})),
pv AS (SELECT {ks}, greatest(0, least(1, CASE WHEN any_value(flip) THEN 1 - any_value(front) * arg_max(h, m) / any_value(a)
  ELSE any_value(front) * arg_max(h, m) / any_value(a) END)) AS p FROM bc GROUP BY {ks})"""


def names_sql(names: str) -> str:
    """A list of names as the narratives write it: 'a', 'b' and 'c'."""
    q = f"list_transform({names}, lambda n: chr(39) || n || chr(39))"
    return (f"CASE len({names}) WHEN 0 THEN '' WHEN 1 THEN {q}[1] "
            f"ELSE array_to_string({q}[1:-2], ', ') || ' and ' || {q}[-1] END")


def text(s: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def sentences(*parts: str) -> str:
    """Sentences that are not null, a blank between them."""
    return "array_to_string([s FOR s IN [" + ", ".join(parts) + "] IF s IS NOT NULL], ' ')"


def ranked_narrative_sql(source: str, score: str, method: str, first: str, rest: str, caveat: str) -> str:
    """The best feature and the others in order, from ``source`` (target, feature, pos, the score)."""
    order = f"ORDER BY {score} DESC, pos"
    top = f"printf({text(first)}, list(feature {order})[1], chr(39) || target || chr(39), max({score}))"
    others = f"CASE WHEN count(*) > 1 THEN printf({text(rest)}, {names_sql(f'list(feature {order})[2:]')}) END"
    return f"SELECT target, '{method}' AS method, {sentences(top, others, text(caveat))} AS narrative FROM {source} GROUP BY target"


def correlation_narrative_sql(source: str, templates: dict, caveat: str, strong: float = 0.5, moderate: float = 0.3,
                              large: float = 0.14, medium: float = 0.06, weak_r: float = 0.1, weak_p: float = 0.05) -> str:
    """N2-N4, N9 from ``source`` (target, feature, pos, pearson_r, pearson_p, spearman_r, spearman_p, eta2, anova_p)."""
    quoted = "chr(39) || target || chr(39)"

    def linear(m: str, label: str, assoc: str, sym: str) -> str:
        r, p, sig = f"{m}_r", f"{m}_p", f"({m}_p < 0.05)"
        key = f"struct_pack(a := -abs({r}), b := pos)"
        best = lambda c: f"arg_min({c}, {key}) FILTER ({sig})"
        power = f"CASE WHEN abs({best(r)}) >= {strong} THEN 'strong' WHEN abs({best(r)}) >= {moderate} THEN 'moderate' ELSE 'weak' END"
        top = (f"CASE WHEN count(*) FILTER ({sig}) = 0 THEN printf({text(templates['corr_none'].format(label=label))}, {quoted}) "
               f"ELSE printf({text(templates['corr_top'].format(label=label, assoc=assoc, sym=sym))}, {best('feature')}, {power}, "
               f"CASE WHEN {best(r)} > 0 THEN 'positive' ELSE 'negative' END, {quoted}, {best(r)}, {best(p)}) END")
        total = f"CASE WHEN count(*) FILTER ({sig}) > 1 THEN printf({text(templates['corr_total'].format(label=label))}, (count(*) FILTER ({sig}))::INT, {quoted}) END"
        flat = f"list(feature ORDER BY pos) FILTER (abs({r}) < {weak_r} AND {p} > {weak_p})"
        none = f"CASE WHEN len({flat}) > 0 THEN printf({text(templates['corr_no_linear'])}, {names_sql(flat)}, {quoted}) END" if m == "pearson" else "NULL"
        return f"SELECT target, {top} AS a, {total} AS b, {none} AS c FROM {source} WHERE {r} IS NOT NULL GROUP BY target"

    sig, key = "(anova_p < 0.05)", "struct_pack(a := -eta2, b := pos)"
    best = lambda c: f"arg_min({c}, {key}) FILTER ({sig})"
    size = f"CASE WHEN {best('eta2')} >= {large} THEN 'large' WHEN {best('eta2')} >= {medium} THEN 'medium' ELSE 'small' END"
    everyone = "list(feature ORDER BY pos)"
    anova = f"""SELECT target, CASE WHEN count(*) FILTER ({sig}) = 0 THEN printf({text(templates['anova_none'])}, {quoted}, {names_sql(everyone)})
  ELSE printf({text(templates['anova_top'])}, {best('feature')}, {quoted}, {best('eta2')}, {best('anova_p')}, {size}) END AS a,
  CASE WHEN count(*) FILTER ({sig}) > 1 THEN printf({text(templates['anova_others'])}, {names_sql(f'{everyone} FILTER ({sig} AND place > 1)')}, {quoted}) END AS b,
  CASE WHEN count(*) FILTER (NOT {sig}) > 0 THEN printf({text(templates['anova_non_sig'])}, {names_sql(f'{everyone} FILTER (NOT {sig})')}, {quoted}) END AS c
  FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY eta2 DESC, pos) AS place FROM {source} WHERE eta2 IS NOT NULL) GROUP BY target"""
    return f"""SELECT target, 'correlations' AS method, {sentences('p.a', 'p.b', 'p.c', 's.a', 's.b', 's.c', 'v.a', 'v.b', 'v.c', text(caveat))} AS narrative
FROM ({linear('pearson', 'Pearson', 'linear', 'r')}) p LEFT JOIN ({linear('spearman', 'Spearman', 'monotonic', 'rho')}) s USING (target)
LEFT JOIN ({anova}) v USING (target)"""
