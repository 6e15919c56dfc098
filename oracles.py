"""The catalogue's results written as plain SQL, for comparison with another engine."""

from __future__ import annotations

import oracles_search
from riskloom.functions import columns
from riskloom.operators import hypothesis

QUALITY = ["k_chars", "word_density", "digit_share", "toxic"]
ORDERS = ["price", "balance", "quantity", "discount", "tax", "lines"]
EVENTS = ["value", "k", "hour"]

QUALITY_FRAME = """quality AS (
  SELECT l.doc_id AS id, CAST(1 - l.quality AS INTEGER) AS yd, length(d.text) / 1000::DOUBLE AS k_chars,
         (length(d.text) - length(replace(d.text, ' ', ''))) / greatest(length(d.text), 1)::DOUBLE AS word_density,
         (length(d.text) - length(translate(d.text, '0123456789', ''))) / greatest(length(d.text), 1)::DOUBLE
           AS digit_share,
         CAST(l.toxic AS DOUBLE) AS toxic
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

ORDERS_FRAME = """orders_f AS (
  SELECT o.o_orderkey AS id, CAST(o.o_orderstatus = 'F' AS INTEGER) AS yd,
         o.o_totalprice / 1000::DOUBLE AS price, c.c_acctbal / 1000::DOUBLE AS balance,
         quantity, discount, tax, lines
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, avg(l_discount) AS discount,
                    avg(l_tax) AS tax, CAST(count(*) AS DOUBLE) AS lines
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey)"""

CODED_EVENTS = """coded AS (
  SELECT event_id AS id, CAST(event_type = 'error' AS INTEGER) AS yd,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) < 3 THEN -99.99 ELSE value END AS value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(extract(hour FROM ts) AS DOUBLE) AS hour
  FROM events)"""

EVENTS_FRAME = CODED_EVENTS + """, events_f AS (
  SELECT id, yd, nullif(value, -99.99) AS value, k, hour FROM coded)"""

FRAMES = {"quality": QUALITY_FRAME, "orders_f": ORDERS_FRAME, "events_f": EVENTS_FRAME}
FEATURES = {"quality": QUALITY, "orders_f": ORDERS, "events_f": EVENTS}

INDEXED = ORDERS_FRAME + """, indexed AS (
  SELECT * RENAME (id AS row_key),
         row_number() OVER (ORDER BY yd, price, id) - 1 AS id,
         CAST((row_number() OVER (ORDER BY yd, price, id) - 1) % 2 = 0 AS INTEGER) AS dumVE
  FROM orders_f)"""


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def rs(names: list[str], digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def long_rows(frame: str, features: list[str], keep: str = "id, yd") -> str:
    """One row per feature, NULLs included."""
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM {frame}" for c in features
    )


def on(frame: str, body: str, extra: str = "") -> str:
    return f"WITH {FRAMES[frame]}{', ' + extra if extra else ''} {body}"


# Simpson's rule with 2000 panels on the normal and Student densities.
PANELS = 2000
WEIGHT = f"(CASE WHEN i = 0 OR i = {PANELS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def integral(integrand: str, upper: str) -> str:
    """Integral from 0 to `upper` of an expression in `u`; `u` stands for the point."""
    at = integrand.replace("{u}", f"(i * ({upper}) / {PANELS}.0)")
    return (
        f"(({upper}) / {3 * PANELS}.0 * list_sum(list_transform(range(0, {PANELS + 1}), "
        f"lambda i: {WEIGHT} * {at})))"
    )


def student_p(t: str, df: str) -> str:
    scale = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi())"
    area = integral(f"pow(cos({{u}}), ({df}) - 1)", f"atan(abs({t}) / sqrt({df}))")
    return f"CASE WHEN ({t}) IS NOT NULL THEN greatest(0.0, 1 - 2 * {scale} * {area}) END"


def normal_p(z: str) -> str:
    """Two-sided."""
    area = integral("exp(-{u} * {u} / 2)", f"least(abs({z}), 40)")
    return f"greatest(0.0, 1 - 2 / sqrt(2 * pi()) * {area})"


def normal_cdf(x: str, terms: int = 90) -> str:
    """Power series of the distribution function, written inside out."""
    value = "1"
    for k in range(terms, 0, -1):
        value = f"1 + x2 / {2 * k + 1} * ({value})"
    return value


def moment_rows(frame: str, features: list[str], by: str = "yd") -> str:
    group = f"{by}, " if by else ""
    return (
        f"SELECT {group}variable, count(value) AS n, count(*) - count(value) AS n_missing, "
        "avg(value) AS mean, stddev_samp(value) AS std, var_samp(value) AS variance, "
        "min(value) AS min, max(value) AS max, var_pop(value) AS m2, "
        "CASE WHEN var_pop(value) > 0 THEN "
        "avg(pow(value - centre, 3)) / pow(var_pop(value), 1.5) END AS skewness, "
        "CASE WHEN var_pop(value) > 0 THEN "
        "avg(pow(value - centre, 4)) / pow(var_pop(value), 2) - 3 END AS kurtosis "
        f"FROM (SELECT *, avg(value) OVER (PARTITION BY {group}variable) AS centre "
        f"FROM ({long_rows(frame, features)})) GROUP BY {group}variable"
    )


def classes(frame: str, features: list[str], group: str = "yd", value: str | None = None) -> str:
    """Counts, means and variances of the two classes side by side."""
    source = value or long_rows(frame, features, group)
    pick = ", ".join(
        f"{f}(value) FILTER (WHERE {group} = {g}) AS {name}{g}"
        for g in (0, 1)
        for f, name in (("count", "n"), ("avg", "mean"), ("var_samp", "v"))
    )
    return f"SELECT variable, {pick} FROM ({source}) GROUP BY variable"


POOLED = "((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)"
POOLED_T = f"(mean0 - mean1) / sqrt({POOLED} * (1.0 / n0 + 1.0 / n1))"
WELCH_T = "(mean0 - mean1) / sqrt(v0 / n0 + v1 / n1)"
WELCH_DF = "pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1))"


def means_test(frame: str, features: list[str], pooled: list[str], extra: str = "", where: str = "", more: str = "") -> str:
    names = ", ".join(f"'{c}'" for c in pooled) or "''"
    body = (
        f"SELECT variable, CASE WHEN variable IN ({names}) THEN {POOLED_T} ELSE {WELCH_T} END AS t, "
        f"CASE WHEN variable IN ({names}) THEN n0 + n1 - 2 ELSE {WELCH_DF} END AS df "
        f"FROM ({classes(frame, features)})"
    )
    return on(
        frame,
        f"SELECT variable, {r('t', 't_statistic')}, {r('df', 'df')}, {r('p', 'p_value')}{more} "
        f"FROM (SELECT *, {student_p('t', 'df')} AS p FROM ({body})) {where}",
        extra,
    )


def biserial_rows(frame: str, features: list[str]) -> str:
    return (
        f"SELECT variable, r, t, {student_p('t', 'n - 2')} AS p FROM ("
        "SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ("
        f"SELECT variable, corr(value, yd) AS r, count(value) AS n FROM ({long_rows(frame, features)}) "
        "WHERE value IS NOT NULL GROUP BY variable))"
    )


def levene_rows(frame: str, features: list[str], centre: str, group: str = "yd") -> str:
    far = (
        f"SELECT {group}, variable, abs(value - {centre}(value) OVER (PARTITION BY {group}, variable)) AS value "
        f"FROM ({long_rows(frame, features, group)}) WHERE value IS NOT NULL"
    )
    grand = "(n0 * mean0 + n1 * mean1) / (n0 + n1)"
    return (
        f"SELECT variable, (n0 + n1 - 2) * (n0 * pow(mean0 - {grand}, 2) + n1 * pow(mean1 - {grand}, 2)) "
        f"/ ((n0 - 1) * v0 + (n1 - 1) * v1) AS f, n0 + n1 - 2 AS df FROM ({classes(frame, features, group, far)})"
    )


def levene(frame: str, features: list[str], centre: str) -> str:
    return on(
        frame,
        f"SELECT variable, {r('f', 'statistic')}, {r(student_p('sqrt(f)', 'df'), 'p_value')} "
        f"FROM ({levene_rows(frame, features, centre)})",
    )


def quantile_nearest(p: float) -> str:
    return f"max(value) FILTER (WHERE place = CAST(floor({p} * (n - 1) + 0.5) AS BIGINT))"


def describe(frame: str, features: list[str], by: str) -> str:
    group = f"{by}, " if by else ""
    cuts = ", ".join(
        r(f"quantile_cont(value, {p})", f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)
    )
    return on(
        frame,
        f"SELECT {group}variable, count(value) AS n, count(*) - count(value) AS n_missing, "
        f"{r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, {cuts}, "
        f"{r('max(value)', 'max')} FROM ({long_rows(frame, features)}) GROUP BY {group}variable",
    )


def hash_order(key: str, partition: str = "") -> str:
    return (
        f"row_number() OVER ({'PARTITION BY ' + partition if partition else ''} "
        f"ORDER BY substr(md5(CAST({key} AS VARCHAR) || ':42'), 1, 13), {key})"
    )


def box(frame: str, features: list[str]) -> str:
    """CTEs: values with the quartiles and fences of their class and variable."""
    return (
        f"{FRAMES[frame]}, v AS ({long_rows(frame, features)}), q AS (SELECT yd, variable, "
        "quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
        "quantile_cont(value, 0.75) AS q3 FROM v GROUP BY yd, variable), "
        "b AS (SELECT v.*, q1, median, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) "
        "AS inside FROM v JOIN q USING (yd, variable) WHERE value IS NOT NULL)"
    )


def horner(coefficients: list[float], x: str) -> str:
    value = repr(coefficients[-1])
    for k in reversed(coefficients[:-1]):
        value = f"({value} * {x} + {k!r})"
    return f"CAST({value} AS DOUBLE)"


def normal_quantile(p: str) -> str:
    q = f"(({p}) - 0.5)"
    r_ = f"(0.180625 - {q} * {q})"
    t = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {horner(columns.CENTRE_TOP, r_)} / {horner(columns.CENTRE_BOTTOM, r_)} "
        f"ELSE sign({q}) * {horner(columns.MIDDLE_TOP, f'({t} - 1.6)')} / {horner(columns.MIDDLE_BOTTOM, f'({t} - 1.6)')} END"
    )


def shapiro_ctes(frame: str, features: list[str]) -> str:
    """Ordered values with normal scores and weights (more than 11 rows per class); W and its z."""
    last, nxt = horner(hypothesis.LAST_WEIGHT, "u"), horner(hypothesis.NEXT_WEIGHT, "u")
    mean, spread = horner(hypothesis.LARGE_MEAN, "ln(n)"), horner(hypothesis.LARGE_SPREAD, "ln(n)")
    return (
        f"sw0 AS (SELECT yd, variable, value, row_number() OVER (PARTITION BY yd, variable ORDER BY value) AS i, "
        f"CAST(count(*) OVER (PARTITION BY yd, variable) AS DOUBLE) AS n FROM ({long_rows(frame, features)}) "
        "WHERE value IS NOT NULL), "
        f"sw1 AS (SELECT *, {normal_quantile('(i - 0.375) / (n + 0.25)')} AS m FROM sw0), "
        "sw2 AS (SELECT *, sum(m * m) OVER g AS mm, max(m) OVER g AS m1, "
        "max(CASE WHEN i = n - 1 THEN m END) OVER g AS m2, 1 / sqrt(n) AS u, avg(value) OVER g AS centre "
        "FROM sw1 WINDOW g AS (PARTITION BY yd, variable)), "
        f"sw3 AS (SELECT *, {last} + m1 / sqrt(mm) AS a1, {nxt} + m2 / sqrt(mm) AS a2 FROM sw2), "
        "sw4 AS (SELECT *, CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 "
        "WHEN i = 2 THEN -a2 ELSE m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) "
        "END AS a FROM sw3), "
        "sw5 AS (SELECT yd, variable, any_value(n) AS n, pow(sum(a * (value - centre)), 2) / "
        "sum(pow(value - centre, 2)) AS w FROM sw4 GROUP BY yd, variable), "
        f"sw AS (SELECT *, (ln(1 - w) - {mean}) / exp({spread}) AS z FROM sw5)"
    )


def upper_p(z: str) -> str:
    return f"CASE WHEN {z} >= 0 THEN {normal_p(z)} / 2 ELSE 1 - {normal_p(z)} / 2 END"


# ---------------------------------------------------------------- one-variable fits by iteration

STEP = (
    "b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, "
    "b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1"
)


def iterate(name: str, rows: str, gradient: str, weight: str, steps: int, penalty: float = 0.0) -> str:
    """Scoring steps from 0, with a quadratic penalty on the slope; `rows` selects x, y, b0, b1 and helpers from `fit` and the step before."""
    ctes = [f"{name}_0 AS MATERIALIZED (SELECT 0::DOUBLE AS b0, 0::DOUBLE AS b1)"]
    for i in range(1, steps + 1):
        ctes.append(
            f"{name}_{i} AS MATERIALIZED (SELECT {STEP} FROM (SELECT any_value(b0) AS b0, "
            f"any_value(b1) AS b1, sum({gradient}) AS g0, sum(({gradient}) * x) - {penalty} * any_value(b1) AS g1, "
            f"sum({weight}) AS h00, sum(({weight}) * x) AS h01, sum(({weight}) * x * x) + {penalty} AS h11 "
            f"FROM ({rows.replace('{prior}', f'{name}_{i - 1}')})))"
        )
    ctes.append(f"{name} AS MATERIALIZED (SELECT b0, b1 FROM {name}_{steps})")
    return ", ".join(ctes)


def logit_rows(prior: str = "{prior}", source: str = "fit") -> str:
    return (
        "SELECT *, 1 / (1 + exp(-eta)) AS p FROM (SELECT f.*, b0, b1, b0 + b1 * f.x AS eta "
        f"FROM {source} f, {prior})"
    )


def probit_rows(prior: str = "{prior}", source: str = "fit") -> str:
    return (
        f"SELECT *, 0.5 + d * eta * ({normal_cdf('eta')}) AS p FROM (SELECT *, eta * eta AS x2, "
        "exp(-eta * eta / 2) / sqrt(2 * pi()) AS d FROM (SELECT f.*, b0, b1, b0 + b1 * f.x AS eta "
        f"FROM {source} f, {prior}))"
    )


def logit_fit(steps: int = 12) -> str:
    return iterate("logit", logit_rows(), "y - p", "p * (1 - p)", steps)


def probit_fit(steps: int = 30) -> str:
    return iterate("probit", probit_rows(), "(y - p) * d / (p * (1 - p))", "d * d / (p * (1 - p))", steps)


OLS_FIT = "ols AS (SELECT regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1 FROM fit)"


def fit_rows(frame: str, x: str, where: str = "TRUE") -> str:
    return (
        f"{FRAMES[frame]}, fit AS MATERIALIZED (SELECT id, CAST(yd AS DOUBLE) AS y, "
        f"CAST({x} AS DOUBLE) AS x FROM {frame} WHERE {x} IS NOT NULL AND {where})"
    )


QUALITY_FIT = fit_rows("quality", "word_density")
THREE_FITS = f"{QUALITY_FIT}, {OLS_FIT}, {logit_fit()}, {probit_fit()}"
LOGIT_INFO = "p * (1 - p)"
PROBIT_EXPECTED = "d * d / (p * (1 - p))"
PULL = "((2 * y - 1) * d / (CASE WHEN y = 1 THEN p ELSE 1 - p END))"
PROBIT_OBSERVED = f"{PULL} * ({PULL} + eta)"


def errors(weight: str, rows: str, model: str) -> str:
    """Coefficients with standard errors from a weight per row."""
    sums = (
        f"SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum({weight}) AS h00, "
        f"sum(({weight}) * x) AS h01, sum(({weight}) * x * x) AS h11 FROM ({rows})"
    )
    return (
        f"SELECT '{model}' AS model, t.term AS term, t.coef AS coef, t.se AS se FROM (SELECT unnest(["
        "{'term': 'const', 'coef': b0, 'se': sqrt(h11 / (h00 * h11 - h01 * h01))}, "
        "{'term': 'word_density', 'coef': b1, 'se': sqrt(h00 / (h00 * h11 - h01 * h01))}]) AS t "
        f"FROM ({sums}))"
    )


def binary_table(ctes: str, weight: str, rows: str, model: str) -> str:
    z = "1.959963984540054"
    return (
        f"WITH {ctes} SELECT model, term, {r('coef', 'coef', 5)}, {r('se', 'std_err', 5)}, "
        f"{r('coef / se', 'statistic', 5)}, {r(normal_p('coef / se'), 'p_value', 5)}, "
        f"{r(f'coef - {z} * se', 'ci_low', 5)}, {r(f'coef + {z} * se', 'ci_high', 5)} "
        f"FROM ({errors(weight, rows, model)})"
    )


OLS_ERRORS = (
    "SELECT 'OLS' AS model, t.term AS term, t.coef AS coef, t.se AS se FROM (SELECT unnest(["
    "{'term': 'const', 'coef': b0, 'se': sqrt(s2 * (1 / n + mx * mx / sxx))}, "
    "{'term': 'word_density', 'coef': b1, 'se': sqrt(s2 / sxx)}]) AS t FROM (SELECT any_value(b0) AS b0, "
    "any_value(b1) AS b1, sum(pow(y - b0 - b1 * x, 2)) / (count(*) - 2) AS s2, "
    "CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, var_pop(x) * count(*) AS sxx FROM fit, ols))"
)


def scores_sql() -> str:
    """id, y, x and the three scores."""
    return (
        "SELECT o.id AS id, o.y AS y, o.x AS x, o.s AS score_ols, l.p AS score_logit, q.p AS score_probit "
        "FROM (SELECT fit.*, b0 + b1 * x AS s FROM fit, ols) o "
        f"JOIN ({logit_rows('logit')}) l ON l.id = o.id JOIN ({probit_rows('probit')}) q ON q.id = o.id"
    )


def residual_rows() -> str:
    clip = "greatest({low}, least(1 - {low}, {c}))"
    parts = []
    for model, c, low in (("OLS", "score_ols", "1e-6"), ("Logit", "score_logit", "1e-12"),
                          ("Probit", "score_probit", "1e-12")):
        p = clip.replace("{low}", low).replace("{c}", c)
        shown = clip.replace("{low}", "1e-9").replace("{c}", c)
        parts.append(
            f"SELECT id, CAST(y AS INTEGER) AS y, '{model}' AS model, {shown} AS p_hat, "
            f"(y - {p}) / sqrt({p} * (1 - {p})) AS residual FROM s"
        )
    return f"WITH {THREE_FITS}, s AS MATERIALIZED ({scores_sql()}), res AS ({' UNION ALL '.join(parts)})"


# ---------------------------------------------------------------- two-variable least squares

TWO = (
    "two AS MATERIALIZED (SELECT id, quantity AS x1, lines AS x2, price AS y FROM orders_f "
    "WHERE quantity IS NOT NULL AND lines IS NOT NULL), "
    "mom AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, "
    "var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, "
    "covar_pop(x2, y) AS s2y, var_pop(y) AS syy FROM two), "
    "sol AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, "
    "(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM mom), "
    "fin AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (syy - b1 * s1y - b2 * s2y) AS sse, "
    "n * syy AS sst, (s11 * s22 - s12 * s12) AS det FROM sol)"
)

OLS_TABLE = (
    "SELECT 'OLS' AS model, t.term AS term, t.b AS b, t.se AS se, df FROM (SELECT unnest(["
    "{'term': 'const', 'b': b0, 'se': sqrt(s2 / n * (1 + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det))}, "
    "{'term': 'quantity', 'b': b1, 'se': sqrt(s2 * s22 / (n * det))}, "
    "{'term': 'lines', 'b': b2, 'se': sqrt(s2 * s11 / (n * det))}]) AS t, n - 3 AS df "
    "FROM (SELECT *, sse / (n - 3) AS s2 FROM fin))"
)


def gaussian_table() -> str:
    return (
        TWO.replace("quantity AS x1, lines AS x2, price AS y FROM orders_f WHERE quantity IS NOT NULL "
                    "AND lines IS NOT NULL",
                    "k AS x1, hour AS x2, value AS y FROM events_f WHERE value IS NOT NULL")
    )


# ---------------------------------------------------------------- neighbours


def knn(frame: str, features: list[str], gaps: list[str], k: int = 3) -> str:
    """All pairs of incomplete rows and complete donors, for frames whose gaps come together."""
    seen = [c for c in features if c not in gaps]
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in features)
    scaled = ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in seen)
    square = " + ".join(f"pow(q.z_{c} - d.z_{c}, 2)" for c in seen)
    near = (
        f"SELECT q.id AS id, {', '.join(f'd.{c} AS {c}' for c in gaps)}, row_number() OVER (PARTITION BY q.id "
        f"ORDER BY round(({square}) * {len(features)}.0 / {len(seen)}, 9), d.id) AS place "
        f"FROM z q, z d WHERE q.{gaps[0]} IS NULL AND d.{gaps[0]} IS NOT NULL"
    )
    filled = ", ".join(
        r(f"coalesce(z.{c}, f.{c})", c) if c in gaps else r(f"z.{c}", c) for c in features
    )
    return on(
        frame,
        f"SELECT z.id AS id, z.yd AS yd, {filled} FROM z LEFT JOIN f ON f.id = z.id",
        f"st AS (SELECT {stats} FROM {frame}), z AS MATERIALIZED (SELECT {frame}.*, {scaled} FROM {frame}, st), "
        f"f AS (SELECT id, {', '.join(f'avg({c}) AS {c}' for c in gaps)} FROM ({near}) WHERE place <= {k} GROUP BY id)",
    )


# ---------------------------------------------------------------- scores


def concordance_rows(source: str, by: str) -> str:
    """Pair counts per group from sorted class counts."""
    return (
        f"SELECT {by}, CAST(sum(pos * below) AS DOUBLE) AS c, CAST(sum(pos * neg) AS DOUBLE) AS t, "
        f"CAST(sum(pos) AS DOUBLE) AS p, CAST(sum(neg) AS DOUBLE) AS n FROM (SELECT *, "
        f"coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING "
        f"AND 1 PRECEDING), 0) AS below FROM (SELECT {by}, score, sum(yd) AS pos, sum(1 - yd) AS neg "
        f"FROM ({source}) WHERE score IS NOT NULL GROUP BY {by}, score)) GROUP BY {by}"
    )


def auc_of(source: str, by: str, digits: int = 6) -> str:
    return (
        f"SELECT {by}, {r('CASE WHEN p * n > 0 THEN (c + t / 2) / (p * n) END', 'auc', digits)} "
        f"FROM ({concordance_rows(source, by)})"
    )


def score_rows(frame: str, features: list[str]) -> str:
    return (
        f"SELECT yd, variable AS model, value AS score FROM ({long_rows(frame, features)})"
    )


def roc_points(frame: str, score: str) -> str:
    return (
        f"g AS (SELECT {score} AS threshold, sum(yd) AS pos, sum(1 - yd) AS neg FROM {frame} "
        f"WHERE {score} IS NOT NULL GROUP BY 1), c AS (SELECT *, "
        "sum(pos) OVER w / sum(pos) OVER () AS tpr, sum(neg) OVER w / sum(neg) OVER () AS fpr, "
        "lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS place, "
        "count(*) OVER () AS points FROM g "
        "WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    )


SHARE = "1 - exp(-value / 200)"


def cost_grid(score: str, cost_fn: float = 10.0) -> str:
    return (
        f"grid AS (SELECT i / 200.0::DOUBLE AS thr FROM range(1, 200) g(i)), curve AS (SELECT thr, "
        f"sum(CASE WHEN yd = 1 AND s < thr THEN {cost_fn} WHEN yd = 0 AND s >= thr THEN 1.0 ELSE 0 END)"
        f"::DOUBLE / count(*) AS cost FROM (SELECT yd, {score} AS s FROM events_f) e, grid "
        "WHERE s IS NOT NULL GROUP BY thr)"
    )


ORACLES: dict[str, str] = {}


def add(**entries: str) -> None:
    ORACLES.update(entries)


ORDER_CASES = " AND ".join(f"{c} IS NOT NULL" for c in ORDERS)
EVENT_CASES = " AND ".join(f"{c} IS NOT NULL" for c in EVENTS)

add(
    a1_delimited_read=on("events_f", f"SELECT id, yd, {rs(EVENTS)} FROM events_f"),
    a2_sentinel_to_null=on("events_f", f"SELECT id, yd, {rs(EVENTS)} FROM events_f"),
    a3_null_tokens=on("events_f", f"SELECT id, yd, {rs(EVENTS)} FROM events_f"),
    a4_stored_samples=f"WITH {INDEXED} SELECT yd, count(*) AS n, {r('avg(price)', 'mean_price')}, "
    "count(quantity) AS n_quantity FROM indexed WHERE dumVE = 0 GROUP BY yd",
    a5_result_table=on(
        "orders_f",
        f"SELECT yd, variable, {rs(['kurtosis', 'skewness'])} FROM ({moment_rows('orders_f', ORDERS)})",
    ),
    b1_all_but=on("orders_f", f"SELECT {rs(ORDERS)} FROM orders_f"),
    b2_feature_resolution=on("events_f", f"SELECT id, {rs(['hour', 'value'])} FROM events_f"),
    b3_numeric_columns=f"SELECT c_custkey, c_nationkey, {r('c_acctbal', 'c_acctbal')} FROM customer",
    b4_filtered_sample=f"WITH {INDEXED} SELECT id, row_key, {r('price', 'price')} FROM indexed "
    "WHERE dumVE = 0 AND yd = 1",
    b5_finite_rows=on(
        "events_f",
        f"SELECT id, yd, {r('value / k', 'ratio', 9)} FROM events_f WHERE k <> 0 AND value IS NOT NULL",
    ),
    b6_complete_cases=on("orders_f", f"SELECT id, yd, {rs(ORDERS)} FROM orders_f WHERE {ORDER_CASES}"),
    b7_nan_to_null=on("events_f", f"SELECT id, yd, {rs(EVENTS)} FROM events_f"),
    b8_derived_columns=on("events_f", "SELECT id, yd, 1 - yd AS ynd, yd - (1 - yd) AS z FROM events_f"),
    b9_casts_b10_rename=on(
        "events_f",
        'SELECT id AS "row", yd AS flag, CAST(hour AS INTEGER) AS hour, CAST(yd AS DOUBLE) AS y FROM events_f',
    ),
    b11_binary_target=on("quality", "SELECT yd, count(*) AS n FROM quality GROUP BY yd"),
    b12_missing_cells=on(
        "orders_f",
        "SELECT variable, count(*) - count(value) AS n_missing FROM "
        f"({long_rows('orders_f', ORDERS)}) GROUP BY variable",
    ),
    b13_clip=on(
        "orders_f",
        "SELECT id, round(CASE WHEN balance IS NOT NULL THEN greatest(0.0, least(5.0, balance)) END, 6) + 0.0 "
        "AS balance FROM orders_f",
    ),
    b14_display_rounding=on(
        "orders_f",
        f"SELECT variable, {r('t', 't_stat', 3)}, {r('p', 'p_value', 3)} FROM ({biserial_rows('orders_f', ORDERS)})",
    ),
    b15_label_match="SELECT o_orderkey FROM orders WHERE lower(trim(o_orderpriority)) = '1-urgent'",
    b16_outlier_flag=on(
        "orders_f",
        f"SELECT id, {r('z', 'quantity')}, abs(z) > 2 AS outlier FROM (SELECT id, (quantity - avg(quantity) "
        "OVER ()) / stddev_pop(quantity) OVER () AS z FROM orders_f)",
    ),
    b17_threshold_class=on(
        "events_f",
        "SELECT CAST(value >= 50 AS INTEGER) AS said, yd, count(*) AS n FROM events_f GROUP BY 1, 2",
    ),
    b18_optional_columns=on(
        "events_f",
        "SELECT id AS row_key, row_number() OVER (ORDER BY hour NULLS LAST, value NULLS LAST, id) - 1 AS id "
        "FROM events_f",
    ),
    b20_error_to_missing=on(
        "events_f",
        "SELECT id, round(CASE WHEN k <> 0 THEN value / k END, 9) + 0.0 AS ratio, "
        "round(CASE WHEN k > 0 THEN ln(k) END, 9) + 0.0 AS log_k FROM events_f",
    ),
    c1_sorted_c4_top=on(
        "orders_f",
        "SELECT id, round(q, 6) + 0.0 AS quantity FROM (SELECT id, quantity AS q FROM orders_f "
        "ORDER BY quantity NULLS LAST, id LIMIT 25)",
    ),
    c2_global_index=f"WITH {INDEXED} SELECT id, row_key FROM indexed",
    c3_systematic_split=on(
        "events_f",
        "SELECT row_key, id, CAST(id % 2 = 0 AS INTEGER) AS dumVE FROM (SELECT id AS row_key, "
        "row_number() OVER (ORDER BY yd, value NULLS LAST, id) - 1 AS id FROM events_f)",
    ),
    c5_sorted_by_p=means_test(
        "quality", QUALITY, [], where="WHERE p < 0.05",
        more=", row_number() OVER (ORDER BY p NULLS LAST, variable) AS place"),
    c6_by_strength=on(
        "orders_f",
        f"SELECT variable, {r('r', 'r')}, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, variable) AS place "
        f"FROM ({biserial_rows('orders_f', ORDERS)})",
    ),
    c8_stratified_split=on(
        "orders_f",
        "SELECT id, yd, CAST(place <= n_c - keep AS INTEGER) AS in_test FROM (SELECT o.id, o.yd, place, "
        "n_c, base + CAST(spare_rank <= spare AS INTEGER) AS keep FROM "
        f"(SELECT id, yd, {hash_order('id', 'yd')} AS place FROM orders_f) o JOIN "
        "(SELECT *, train - sum(base) OVER () AS spare, row_number() OVER (ORDER BY ideal - base DESC, yd) "
        "AS spare_rank FROM (SELECT yd, n_c, train, train * n_c / n::DOUBLE AS ideal, "
        "floor(train * n_c / n::DOUBLE) AS base FROM (SELECT yd, count(*) AS n_c, sum(count(*)) OVER () AS n, "
        "sum(count(*)) OVER () - ceil(0.25 * sum(count(*)) OVER ()) AS train FROM orders_f GROUP BY yd))) t "
        "ON t.yd = o.yd)",
    ),
    c9_random_split=on(
        "events_f",
        f"SELECT id, CAST({hash_order('id')} <= ceil(0.25 * count(*) OVER ()) AS INTEGER) AS in_test FROM events_f",
    ),
    c10_stratified_folds=on(
        "orders_f",
        "SELECT id, yd, CAST((place > round(0.2 * n)) AS INTEGER) + CAST((place > round(0.4 * n)) AS INTEGER) "
        "+ CAST((place > round(0.6 * n)) AS INTEGER) + CAST((place > round(0.8 * n)) AS INTEGER) AS fold "
        f"FROM (SELECT id, yd, {hash_order('id', 'yd')} AS place, count(*) OVER (PARTITION BY yd) AS n FROM orders_f)",
    ),
    d1_attached_scores=f"WITH {QUALITY_FIT}, {OLS_FIT} SELECT id, yd, {rs(QUALITY)}, "
    f"{r('b0 + b1 * quality.word_density', 'score_ols')} FROM quality, ols",
    d2_members=on(
        "events_f",
        f"SELECT id, yd, {rs(EVENTS)} FROM (SELECT *, {hash_order('id')} <= ceil(0.25 * count(*) OVER ()) "
        "AS picked FROM events_f) e WHERE picked",
    ),
    d6_masked_fill=on(
        "orders_f",
        f"SELECT id, {r('coalesce(orders_f.quantity, -1.0)', 'quantity')}, "
        f"{r('coalesce(orders_f.lines, -2.0)', 'lines')} FROM orders_f",
    ),
    d7_stacked_results="WITH " + ORDERS_FRAME + ", " + QUALITY_FRAME + " " + " UNION ALL ".join(
        f"SELECT yd, variable, n, {rs(['mean', 'std'])} FROM ({moment_rows(f, FEATURES[f])})"
        for f in ("orders_f", "quality")
    ),
    d8_long_form=on(
        "orders_f",
        f"SELECT id, yd, variable, round(v, 6) + 0.0 AS value FROM (SELECT id, yd, variable, value AS v FROM "
        f"({long_rows('orders_f', ORDERS)}))",
    ),
    e1_group_describe=describe("orders_f", ORDERS, "yd"),
    e1_group_describe_nearest=on(
        "events_f",
        "SELECT yd, variable, max(n) AS n, max(n_all) - max(n) AS n_missing, "
        f"{r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')}, "
        + ", ".join(r(quantile_nearest(p), f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75))
        + f", {r('max(value)', 'max')} FROM (SELECT *, count(value) OVER (PARTITION BY yd, variable) AS n, "
        "count(*) OVER (PARTITION BY yd, variable) AS n_all, row_number() OVER (PARTITION BY yd, variable "
        f"ORDER BY value NULLS LAST, id) - 1 AS place FROM ({long_rows('events_f', EVENTS)})) "
        "GROUP BY yd, variable",
    ),
    e2_sample_describe=describe("events_f", EVENTS, ""),
    e3_group_summary=on(
        "orders_f", f"SELECT yd, variable, n, {rs(['mean', 'std'])} FROM ({moment_rows('orders_f', ORDERS)})"
    ),
    e4_e5_shape=on(
        "orders_f",
        f"SELECT yd, variable, {rs(['kurtosis', 'skewness'])} FROM ({moment_rows('orders_f', ORDERS)})",
    ),
    e5_pearson_kurtosis=on(
        "events_f",
        f"SELECT yd, variable, {r('kurtosis + 3', 'kurtosis')}, {r('skewness', 'skewness')} "
        f"FROM ({moment_rows('events_f', EVENTS)}) t",
    ),
    e6_class_counts=on("orders_f", "SELECT yd, count(*) AS n FROM orders_f GROUP BY yd"),
    e7_levels=on("events_f", "SELECT DISTINCT hour FROM events_f"),
    e8_histogram=on(
        "orders_f",
        f"SELECT yd, variable, bin, {r('low + bin * width', '\"left\"')}, n, "
        f"{r('n / sum(n) OVER (PARTITION BY yd, variable)', 'share')} FROM (SELECT yd, variable, bin, "
        "any_value(low) AS low, any_value(width) AS width, count(*) AS n FROM (SELECT yd, variable, low, width, "
        "CAST(least(floor((value - low) / width), 29) AS INTEGER) AS bin FROM (SELECT *, min(value) OVER "
        "(PARTITION BY variable) AS low, (max(value) OVER (PARTITION BY variable) - min(value) OVER "
        f"(PARTITION BY variable)) / 30 AS width FROM ({long_rows('orders_f', ['price', 'balance', 'lines'])})) "
        "WHERE value IS NOT NULL) GROUP BY yd, variable, bin)",
    ),
    e9_box_statistics=f"WITH {box('orders_f', ORDERS)} SELECT yd, variable, {r('any_value(b.q1)', 'q1')}, "
    f"{r('any_value(b.median)', 'median')}, {r('any_value(b.q3)', 'q3')}, "
    f"{r('min(value) FILTER (WHERE inside)', 'lower_whisker')}, "
    f"{r('max(value) FILTER (WHERE inside)', 'upper_whisker')}, "
    "count(*) FILTER (WHERE NOT inside) AS n_outliers FROM b GROUP BY yd, variable",
    e9_box_outliers=f"WITH {box('events_f', EVENTS)} SELECT id, yd, variable, {r('b.value', 'value')} "
    "FROM b WHERE NOT inside",
    e10_density=on(
        "orders_f",
        f"SELECT yd, point, {r('-4 + point * 0.1::DOUBLE', 'x')}, {r('sum(exp(-0.5 * pow((-4 + point * 0.1::DOUBLE - z) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 'density')} "
        "FROM (SELECT *, stddev_samp(z) OVER (PARTITION BY yd) * pow(count(*) OVER (PARTITION BY yd), -0.2) AS h, "
        "count(*) OVER (PARTITION BY yd) AS n FROM (SELECT yd, (price - avg(price) OVER ()) / "
        "stddev_pop(price) OVER () AS z FROM orders_f)), (SELECT CAST(g AS INTEGER) AS point FROM range(0, 81) t(g)) "
        "GROUP BY yd, point",
    ),
    e10_density_epanechnikov=on(
        "orders_f",
        f"SELECT yd, point, {r('-4 + point * 0.1::DOUBLE', 'x')}, "
        f"{r('sum(0.75 * (1 - u * u / 5) / sqrt(5)) / (any_value(n) * any_value(h))', 'density')} "
        "FROM (SELECT *, (-4 + point * 0.1::DOUBLE - z) / h AS u FROM (SELECT yd, z, n, 0.9 * least(sd, iqr / 1.349) * "
        "pow(n, -0.2) AS h FROM (SELECT *, stddev_samp(z) OVER (PARTITION BY yd) AS sd, count(*) OVER "
        "(PARTITION BY yd) AS n, quantile_cont(z, 0.75) OVER (PARTITION BY yd) - quantile_cont(z, 0.25) OVER "
        "(PARTITION BY yd) AS iqr FROM (SELECT yd, (quantity - avg(quantity) OVER ()) / stddev_pop(quantity) "
        "OVER () AS z FROM orders_f) WHERE z IS NOT NULL)), (SELECT CAST(g AS INTEGER) AS point "
        "FROM range(0, 81) t(g))) WHERE abs(u) <= sqrt(5) GROUP BY yd, point",
    ),
    f2_bartlett=on(
        "orders_f",
        f"SELECT variable, {r('x', 'statistic')}, {r(normal_p('sqrt(x)'), 'p_value')} FROM (SELECT variable, "
        f"((n0 + n1 - 2) * ln({POOLED}) - (n0 - 1) * ln(v0) - (n1 - 1) * ln(v1)) / "
        "(1 + (1.0 / (n0 - 1) + 1.0 / (n1 - 1) - 1.0 / (n0 + n1 - 2)) / 3) AS x "
        f"FROM ({classes('orders_f', ORDERS)}))",
    ),
    f3_levene=levene("orders_f", ORDERS, "median"),
    f3_levene_mean=levene("orders_f", ORDERS, "avg"),
    f6_pooled_t=means_test("orders_f", ORDERS, ORDERS),
    f7_welch_t=means_test("orders_f", ORDERS, []),
    f8_equal_means=means_test("quality", QUALITY, ["k_chars", "toxic"]),
    f10_point_biserial=on(
        "quality",
        f"SELECT variable, {r('r', 'r')}, {r('t', 't_stat')}, {r('p', 'p_value')} "
        f"FROM ({biserial_rows('quality', QUALITY)}) b",
    ),
    f10_point_biserial_train=on(
        "events_f",
        f"SELECT variable, {r('r', 'r')}, {r('t', 't_stat')}, {r('p', 'p_value')} "
        f"FROM ({biserial_rows('half', EVENTS)}) b",
        "half AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY yd, value, id) - 1 AS place FROM events_f "
        f"WHERE {EVENT_CASES}) WHERE place % 2 = 1)",
    ),
    f11_equivalence=on(
        "quality",
        f"SELECT test, {r('t', 't_stat')}, {r('p', 'p_value')} FROM (SELECT *, {student_p('t', 'df')} AS p FROM ("
        f"SELECT 'pooled' AS test, {POOLED_T} AS t, n0 + n1 - 2 AS df FROM c UNION ALL "
        f"SELECT 'welch', {WELCH_T}, {WELCH_DF} FROM c UNION ALL "
        "SELECT unnest(['correlation', 'x_on_y', 'y_on_x']), r * sqrt((n - 2) / (1 - r * r)), n - 2 FROM "
        "(SELECT corr(word_density, yd) AS r, count(*) AS n FROM quality)))",
        f"c AS ({classes('quality', ['word_density'])})",
    ),
)


def pair_rows(frame: str, features: list[str], select: str) -> str:
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, {select.replace('{a}', a).replace('{b}', b)} FROM {frame}"
        for a, b in pairs
    )


PAIR_R = "corr({a}, {b}) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n"
STRONG = f"(SELECT * FROM ({pair_rows('orders_f', ORDERS, PAIR_R)}) WHERE abs(r) > 0.8)"
MATRIX = ", ".join(
    r(f"max(corr) FILTER (WHERE var2 = '{c}')", c) for c in EVENTS
)

add(
    f9_split_balance=on(
        "orders_f",
        f"SELECT m.variable AS variable, {r('m.t', 't_statistic')}, {r('m.p', 'p_mean')}, {r('l.f', 'levene')}, "
        f"{r('l.p', 'p_variance')} FROM (SELECT variable, t, {student_p('t', 'df')} AS p FROM (SELECT variable, "
        f"{WELCH_T} AS t, {WELCH_DF} AS df FROM ({classes('parts', ['price', 'balance', 'quantity', 'lines'], 'in_test')}))) m "
        f"JOIN (SELECT variable, f, {student_p('sqrt(f)', 'df')} AS p FROM "
        f"({levene_rows('parts', ['price', 'balance', 'quantity', 'lines'], 'median', 'in_test')})) l USING (variable)",
        "cut AS (" + ORACLES["c8_stratified_split"].split(ORDERS_FRAME, 1)[1] + "), "
        "parts AS (SELECT orders_f.*, in_test FROM orders_f JOIN cut ON cut.id = orders_f.id)",
    ),
    g1_strong_pairs=on("orders_f", f"SELECT var1, var2, {r('r', 'r')}, n FROM {STRONG} s"),
    g2_correlation_pairs=on(
        "orders_f",
        f"SELECT var1, var2, {r('r', 'r')}, n FROM ({pair_rows('orders_f', [*ORDERS, 'yd'], PAIR_R)}) s",
    ),
    g2_correlation_matrix=on(
        "events_f",
        f"SELECT var1 AS variable, {MATRIX} FROM ("
        + " UNION ALL ".join(
            f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS corr FROM whole" for a in EVENTS for b in EVENTS
        )
        + ") GROUP BY var1",
        f"whole AS (SELECT * FROM events_f WHERE {EVENT_CASES})",
    ),
    g3_lower_triangle=on(
        "orders_f",
        f"SELECT var2 AS var1, var1 AS var2, {r('abs(r)', 'abs_r')} FROM ("
        + pair_rows("whole", ORDERS, "corr({a}, {b}) AS r") + ")",
        f"whole AS (SELECT * FROM orders_f WHERE {ORDER_CASES})",
    ),
    g4_strong_columns=on(
        "orders_f", f"SELECT DISTINCT unnest([var1, var2]) AS variable FROM {STRONG}"
    ),
    g5_pair_lines=on(
        "orders_f",
        f"SELECT var1, var2, {r('slope', 'slope')}, {r('icpt', 'intercept')}, n FROM ("
        + pair_rows(
            "orders_f", ORDERS,
            "regr_slope({b}, {a}) AS slope, regr_intercept({b}, {a}) AS icpt, regr_count({b}, {a})::BIGINT AS n",
        ) + ") s",
    ),
    h1_ols=on(
        "orders_f",
        f"SELECT model, term, {r('b', 'coef')}, {r('se', 'std_err')}, {r('b / se', 'statistic')}, "
        f"{r(student_p('b / se', 'df'), 'p_value')} FROM ({OLS_TABLE})",
        TWO,
    ),
    h2_logit=binary_table(f"{QUALITY_FIT}, {logit_fit()}", LOGIT_INFO, logit_rows("logit"), "Logit"),
    h3_probit=binary_table(f"{QUALITY_FIT}, {probit_fit()}", PROBIT_OBSERVED, probit_rows("probit"), "Probit"),
    h3_probit_expected=binary_table(
        f"{QUALITY_FIT}, {probit_fit()}", PROBIT_EXPECTED, probit_rows("probit"), "Probit"
    ),
    h4_coefficients=f"WITH {THREE_FITS} SELECT model, term, {r('t.coef', 'coef', 5)}, {r('se', 'std_err', 5)} FROM "
    f"({OLS_ERRORS} UNION ALL {errors(LOGIT_INFO, logit_rows('logit'), 'Logit')} UNION ALL "
    f"{errors(PROBIT_OBSERVED, probit_rows('probit'), 'Probit')}) t",
    h5_ols_summary=on(
        "orders_f",
        "SELECT 'OLS' AS model, m.k AS measure, round(m.v, 4) + 0.0 AS value FROM (SELECT unnest(["
        "{'k': 'n', 'v': n}, {'k': 'df_model', 'v': 2.0}, {'k': 'df_resid', 'v': n - 3}, "
        "{'k': 'r2', 'v': 1 - sse / sst}, {'k': 'adj_r2', 'v': 1 - (sse / sst) * (n - 1) / (n - 3)}, "
        "{'k': 'f', 'v': f}, {'k': 'f_p_value', 'v': pow(1 + 2 * f / (n - 3), -(n - 3) / 2)}, "
        "{'k': 'loglik', 'v': ll}, {'k': 'aic', 'v': 6 - 2 * ll}, {'k': 'bic', 'v': 3 * ln(n) - 2 * ll}, "
        "{'k': 'skew', 'v': sk}, {'k': 'kurtosis', 'v': ku}, "
        "{'k': 'jarque_bera', 'v': n / 6 * (sk * sk + pow(ku - 3, 2) / 4)}, "
        "{'k': 'jb_p_value', 'v': exp(-n / 12 * (sk * sk + pow(ku - 3, 2) / 4))}, "
        "{'k': 'omnibus', 'v': z1 * z1 + z2 * z2}, {'k': 'omnibus_p_value', 'v': exp(-(z1 * z1 + z2 * z2) / 2)}, "
        "{'k': 'durbin_watson', 'v': dw}, {'k': 'smallest_eigenvalue', 'v': low}, "
        "{'k': 'condition_number', 'v': sqrt(high / low)}]) AS m FROM k2, ev)",
        TWO + """, res AS (SELECT any_value(n) AS n, any_value(sse) AS sse, any_value(sst) AS sst,
          ((any_value(sst) - any_value(sse)) / 2) / (any_value(sse) / (any_value(n) - 3)) AS f,
          -any_value(n) / 2 * (ln(2 * pi() * any_value(sse) / any_value(n)) + 1) AS ll,
          avg(pow(e, 3)) / pow(avg(e * e), 1.5) AS sk, avg(pow(e, 4)) / pow(avg(e * e), 2) AS ku,
          sum(pow(e - prev, 2)) / sum(e * e) AS dw
          FROM (SELECT *, lag(e) OVER (ORDER BY id) AS prev FROM
                (SELECT two.id, y - b0 - b1 * x1 - b2 * x2 AS e, n, sse, sst FROM two, fin))),
        k0 AS (SELECT *, sk * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS sy,
          3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS be,
          (ku - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS kx,
          6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
            * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS be3 FROM res),
        k1 AS (SELECT *, sqrt(2 * (be - 1)) - 1 AS w2,
          6 + 8 / be3 * (2 / be3 + sqrt(1 + 4 / pow(be3, 2))) AS ka FROM k0),
        k2 AS (SELECT *, asinh(sy / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
          (1 - 2 / (9 * ka) - cbrt((1 - 2 / ka) / (1 + kx * sqrt(2 / (ka - 4))))) / sqrt(2 / (9 * ka)) AS z2
          FROM k1),
        cub AS (SELECT n * (1 + s11 + m1 * m1 + s22 + m2 * m2) AS c2,
          n * n * (s11 + s22 + det + s11 * m2 * m2 + s22 * m1 * m1 - 2 * s12 * m1 * m2) AS c1,
          pow(n, 3) * det AS c0 FROM fin),
        ev AS (SELECT list_reduce(list_transform(range(0, 100), lambda i: 0::DOUBLE),
            lambda x, i: x - (((x - c2) * x + c1) * x - c0) / ((3 * x - 2 * c2) * x + c1)) AS low,
          list_reduce(list_transform(range(0, 100), lambda i: c2),
            lambda x, i: x - (((x - c2) * x + c1) * x - c0) / ((3 * x - 2 * c2) * x + c1)) AS high FROM cub)""",
    ),
    h6_h7_binary_summary=f"WITH {QUALITY_FIT}, {logit_fit()}, {probit_fit()}, ll AS ("
    f"SELECT 'Logit' AS model, sum(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS v, count(*)::DOUBLE AS n, "
    f"avg(y) AS m FROM ({logit_rows('logit')}) UNION ALL "
    f"SELECT 'Probit', sum(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), count(*)::DOUBLE, avg(y) "
    f"FROM ({probit_rows('probit')})) "
    "SELECT model, t.k AS measure, round(t.v, 5) + 0.0 AS value FROM (SELECT model, unnest([{'k': 'n', 'v': n}, "
    "{'k': 'loglik', 'v': v}, {'k': 'loglik_null', 'v': z}, {'k': 'lr', 'v': 2 * (v - z)}, "
    "{'k': 'pseudo_r2', 'v': 1 - v / z}, {'k': 'aic', 'v': 4 - 2 * v}, {'k': 'bic', 'v': 2 * ln(n) - 2 * v}]) AS t "
    "FROM (SELECT *, n * (m * ln(m) + (1 - m) * ln(1 - m)) AS z FROM ll))",
    h8_predictions=f"WITH {fit_rows('orders_f', 'price')}, {logit_fit(10)} SELECT id, {r('e.p', 'p')} "
    f"FROM ({logit_rows('logit')}) e",
    h9_scores=f"WITH {THREE_FITS} SELECT id, CAST(y AS INTEGER) AS yd, {r('x', 'word_density', 5)}, "
    + ", ".join(r(f"e.{c}", c, 5) for c in ("score_ols", "score_logit", "score_probit"))
    + f" FROM ({scores_sql()}) e",
    h13_pearson_residuals=f"WITH {fit_rows('orders_f', 'price')}, {logit_fit(10)} SELECT id, "
    f"{r('(y - p) / sqrt(p * (1 - p))', 'residual')} FROM ({logit_rows('logit')})",
    h14_residual_table=f"{residual_rows()} SELECT id, y, model, {r('res.p_hat', 'p_hat', 4)}, "
    f"{r('res.residual', 'residual', 4)}, abs(res.residual) > 2 AS outlier FROM res",
    h14_outliers=f"{residual_rows()} SELECT id, y, {r('res.residual', 'residual', 4)} FROM res "
    "WHERE model = 'Logit' AND abs(res.residual) > 2",
    h15_dummy_trap=on(
        "quality",
        f"SELECT u.m AS model, u.t AS term, {r('u.c', 'coef')} FROM (SELECT unnest(["
        "{'m': 'minimum norm', 't': 'const', 'c': (m0 + m1) / 3}, "
        "{'m': 'minimum norm', 't': 'yd', 'c': (2 * m1 - m0) / 3}, "
        "{'m': 'minimum norm', 't': 'ynd', 'c': (2 * m0 - m1) / 3}, "
        "{'m': 'dropped', 't': 'const', 'c': m0}, {'m': 'dropped', 't': 'yd', 'c': m1 - m0}]) AS u "
        "FROM (SELECT avg(word_density) FILTER (WHERE yd = 0) AS m0, "
        "avg(word_density) FILTER (WHERE yd = 1) AS m1 FROM quality))",
    ),
    h16_contrast_regression=on(
        "quality",
        f"SELECT t.term AS term, {r('t.b', 'coef')}, {r('t.se', 'std_err')} FROM (SELECT unnest(["
        "{'term': 'const', 'b': a, 'se': sqrt(s2 * (1 / n + mz * mz / szz))}, "
        "{'term': 'z', 'b': b, 'se': sqrt(s2 / szz)}]) AS t FROM (SELECT regr_intercept(word_density, z) AS a, "
        "regr_slope(word_density, z) AS b, count(*)::DOUBLE AS n, avg(z) AS mz, var_pop(z) * count(*) AS szz, "
        "(regr_syy(word_density, z) - pow(regr_sxy(word_density, z), 2) / regr_sxx(word_density, z)) / (count(*) - 2) AS s2 "
        "FROM (SELECT *, (2 * yd - 1)::DOUBLE AS z FROM quality)))",
    ),
    h17_gaussian_fit=on(
        "events_f",
        f"SELECT t.term AS term, {r('t.b', 'coef', 5)}, {r('ll', 'loglik', 5)} FROM (SELECT unnest(["
        "{'term': 'const', 'b': b0}, {'term': 'k', 'b': b1}, {'term': 'hour', 'b': b2}]) AS t, "
        "-n / 2 * (ln(2 * pi() * sse / n) + 1) AS ll FROM fin)",
        gaussian_table(),
    ),
    h18_constrained_fit=on(
        "quality",
        f"SELECT t.term AS term, {r('t.b', 'coef')} FROM (SELECT unnest([{{'term': 'const', 'b': (m0 + m1) / 2}}, "
        "{'term': 'yd', 'b': (m1 - m0) / 2}, {'term': 'ynd', 'b': (m0 - m1) / 2}]) AS t FROM ("
        "SELECT avg(word_density) FILTER (WHERE yd = 0) AS m0, avg(word_density) FILTER (WHERE yd = 1) AS m1 "
        "FROM quality))",
    ),
    h19_linear_hypothesis=on(
        "orders_f",
        f"SELECT TRUE AS estimable, 2 AS df1, CAST(n - 3 AS INTEGER) AS df2, {r('f', 'f')}, "
        # With two restrictions the tail of F has a closed form.
        f"{r('pow(1 + 2 * f / (n - 3), -(n - 3) / 2)', 'p_value')} FROM (SELECT n, "
        "((sst - sse) / 2) / (sse / (n - 3)) AS f FROM fin) t",
        TWO,
    ),
    i1_standardize=on(
        "orders_f",
        "SELECT id, yd, " + ", ".join(
            r(f"(orders_f.{c} - avg(orders_f.{c}) OVER ()) / stddev_pop(orders_f.{c}) OVER ()", c) for c in ORDERS
        ) + " FROM orders_f",
    ),
    i2_knn_events=knn("events_f", EVENTS, ["value"]),
    i3_knn_orders=knn("orders_f", ORDERS, ["quantity", "discount", "tax", "lines"]),
    i4_one_hot="SELECT c_custkey, 4 AS width, CAST(c_mktsegment <> 'MACHINERY' AS INTEGER) AS hot FROM customer",
    i5_preprocessor=f"SELECT c_custkey, {r('(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()', 'scaled')}, "
    "CAST((SELECT count(DISTINCT c_mktsegment) FROM customer) + 1 AS INTEGER) AS width FROM customer",
    i6_class_weights=on(
        "orders_f",
        f"SELECT yd, {r('n / (2 * n_c)', 'weight')}, {r('n / 2', 'total')} FROM (SELECT yd, count(*)::DOUBLE AS n_c, "
        "sum(count(*)) OVER ()::DOUBLE AS n FROM orders_f GROUP BY yd)",
    ),
    j1_auc=on("orders_f", auc_of(score_rows("orders_f", ORDERS), "model")),
    j2_roc_curve=on(
        "events_f",
        f"SELECT {rs(['threshold', 'fpr', 'tpr'])} FROM c WHERE place = 1 OR place = points OR next_pos <> pos "
        "OR next_neg <> neg UNION ALL SELECT 'inf'::DOUBLE, 0, 0",
        roc_points("events_f", "k").replace("lead(pos) OVER w", "lead(pos) OVER (ORDER BY threshold DESC)")
        .replace("lead(neg) OVER w", "lead(neg) OVER (ORDER BY threshold DESC)"),
    ),
    j2_roc_curve_full=on(
        "events_f", f"SELECT {rs(['threshold', 'fpr', 'tpr'])} FROM c UNION ALL SELECT 'inf'::DOUBLE, 0, 0",
        roc_points("events_f", "value")
    ),
    j3_roc_area=on(
        "events_f",
        f"SELECT {r('(c + t / 2) / (p * n)', 'area')} FROM "
        f"({concordance_rows(score_rows('events_f', ['value']), 'model')})",
    ),
    j4_concordance=on(
        "events_f",
        "SELECT model, c AS concordant, p * n - c - t AS discordant, t AS ties, "
        f"{r('100 * c / (p * n)', 'percent_concordant')}, {r('(c + t / 2) / (p * n)', 'auc')} FROM "
        f"({concordance_rows(score_rows('events_f', EVENTS), 'model')})",
    ),
    j5_concordance_check=on(
        "orders_f",
        f"SELECT {r('100 * c / (p * n)', 'percent_concordant')}, {r('100 * (c + t / 2) / (p * n)', 'auc_percent')}, "
        "t AS ties, t = 0 AS no_ties, t = 0 AS equal FROM "
        f"({concordance_rows(score_rows('orders_f', ['price']), 'model')})",
    ),
    j6_one_class_auc=on(
        "events_f",
        "SELECT DISTINCT hour, CAST(NULL AS DOUBLE) AS auc FROM events_f WHERE yd = 1 AND value IS NOT NULL",
    ),
    j7_j8_confusion=on(
        "events_f",
        "SELECT tn, fp, fn, tp, tn + fp + fn + tp AS n, round((10.0 * fn + fp)::DOUBLE / (tn + fp + fn + tp), 6) + 0.0 "
        "AS cost FROM (SELECT count(*) FILTER (WHERE s < 0.25 AND yd = 0) AS tn, count(*) FILTER (WHERE s >= 0.25 "
        "AND yd = 0) AS fp, count(*) FILTER (WHERE s < 0.25 AND yd = 1) AS fn, count(*) FILTER (WHERE s >= 0.25 AND "
        f"yd = 1) AS tp FROM (SELECT yd, {SHARE} AS s FROM events_f WHERE value IS NOT NULL))",
    ),
    j9_j11_cutoffs=on(
        "events_f",
        f"SELECT {r('1 / 11.0::DOUBLE', 't_star')}, {r('st.c', 'cost_star')}, {r('avg(thr)', 't_emp')}, "
        f"{r('min(cost)', 'cost_emp')}, count(*) AS n_tied, {r('min(cost) - st.c', 'cost_change')} "
        "FROM curve, (SELECT sum(CASE WHEN yd = 1 AND s < 1 / 11.0::DOUBLE THEN 10.0 WHEN yd = 0 AND "
        "s >= 1 / 11.0::DOUBLE THEN 1.0 ELSE 0 END)::DOUBLE / count(*) AS c FROM "
        f"(SELECT yd, {SHARE} AS s FROM events_f WHERE value IS NOT NULL)) st "
        "WHERE cost = (SELECT min(cost) FROM curve) GROUP BY st.c",
        cost_grid(SHARE),
    ),
    j10_cost_curve=on(
        "events_f", f"SELECT {r('curve.thr', 'thr')}, {r('curve.cost', 'cost')} FROM curve", cost_grid("k / 100")
    ),
    j10_cheapest_cutoffs=on(
        "events_f",
        f"SELECT {r('c.thr', 'thr')}, {r('c.cost', 'cost')} FROM (SELECT * FROM curve ORDER BY cost, thr LIMIT 5) c",
        cost_grid("k / 100", 4.0),
    ),
)


def leverage_ctes() -> str:
    """Orthogonal parts of the centred features, one after the other; their shares add up."""
    frame = ORDERS_FRAME + ", o0 AS (SELECT id, " + ", ".join(
        f"{c} - avg({c}) OVER () AS {c}" for c in ORDERS
    ) + ", 1.0::DOUBLE / count(*) OVER () AS h, count(*) OVER () AS n FROM orders_f WHERE " + ORDER_CASES + ")"
    for i, c in enumerate(ORDERS):
        rest = "".join(
            f", {d} - {c} * (sum({d} * {c}) OVER () / sum({c} * {c}) OVER ()) AS {d}" for d in ORDERS[i + 1:]
        )
        frame += (
            f", o{i + 1} AS (SELECT id, n, h + {c} * {c} / sum({c} * {c}) OVER () AS h{rest} FROM o{i})"
        )
    return frame


TOP = f"o{len(ORDERS)}"
BIG_CUT = f"2.0 * {len(ORDERS) + 1} / n"

def variance_decision(frame: str, features: list[str]) -> str:
    return on(
        frame,
        "SELECT variable, CASE WHEN normal THEN 'bartlett' ELSE 'levene' END AS test, "
        f"{r('p', 'pvalue')}, normal AS decision_normality, {r('p0', 'p_shapiro_0')}, {r('p1', 'p_shapiro_1')}, "
        "p >= 0.05 AS equal_variances, n0, n1, "
        "row_number() OVER (ORDER BY p >= 0.05 NULLS LAST, p NULLS LAST, variable) AS place FROM (SELECT *, CASE WHEN normal THEN pb ELSE pl END AS p FROM "
        "(SELECT c.variable AS variable, n0, n1, p0, p1, pl, "
        f"p0 > 0.05 AND p1 > 0.05 AS normal, {normal_p('sqrt(x)')} AS pb FROM (SELECT variable, n0, n1, "
        f"((n0 + n1 - 2) * ln({POOLED}) - (n0 - 1) * ln(v0) - (n1 - 1) * ln(v1)) / "
        "(1 + (1.0 / (n0 - 1) + 1.0 / (n1 - 1) - 1.0 / (n0 + n1 - 2)) / 3) AS x "
        f"FROM ({classes(frame, features)})) c "
        f"JOIN (SELECT variable, {student_p('sqrt(f)', 'df')} AS pl FROM "
        f"({levene_rows(frame, features, 'median')})) l USING (variable) "
        "JOIN (SELECT variable, max(p) FILTER (WHERE yd = 0) AS p0, max(p) FILTER (WHERE yd = 1) AS p1 FROM "
        f"(SELECT *, {upper_p('z')} AS p FROM sw) GROUP BY variable) s USING (variable)))",
        shapiro_ctes(frame, features),
    )


add(
    b19_math=on(
        "events_f",
        f"SELECT id, {r('sqrt(value)', 'root')}, {r('abs(value - 50)', 'gap')}, {r('pow(value, 0.25)', 'power')}, "
        f"{r('exp(-value / 100)', 'decay')}, {r('k % 7', 'rest')}, "
        f"{r(normal_quantile('(k + 0.5) / 100.5'), 'quantile')} FROM events_f",
    ),
    c4_top_leverage=f"WITH {leverage_ctes()} SELECT id, {r('h', 'leverage')} FROM (SELECT id, h FROM {TOP} "
    f"WHERE h > {BIG_CUT} ORDER BY h DESC, id LIMIT 10)",
    h12_leverage=f"WITH {leverage_ctes()} SELECT orders_f.id AS id, {r('h * 1000', 'leverage')}, "
    f"h > {BIG_CUT} AS high_leverage FROM orders_f LEFT JOIN {TOP} ON {TOP}.id = orders_f.id",
    f1_shapiro_wilk=on(
        "quality",
        f"SELECT yd, variable, CAST(n AS BIGINT) AS n, {r('sw.w', 'w')}, {r(upper_p('z'), 'p_value')}, "
        "n <= 5000 AS p_reliable FROM sw",
        shapiro_ctes("quality", ["k_chars", "word_density"]),
    ),
    f1_shapiro_wilk_large=on(
        "orders_f",
        f"SELECT yd, variable, CAST(n AS BIGINT) AS n, {r('sw.w', 'w')}, {r(upper_p('z'), 'p_value')}, "
        "n <= 5000 AS p_reliable FROM sw",
        shapiro_ctes("orders_f", ORDERS),
    ),
    f4_f5_variance_homogeneity=variance_decision("quality", ["k_chars", "word_density"]),
    f4_f5_variance_homogeneity_large=variance_decision("orders_f", ORDERS),
)


# ---------------------------------------------------------------- fits on samples

STARS = "CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END"


def refit(sample: int, name: str) -> str:
    rows = (
        f"{QUALITY_FRAME}, fit AS MATERIALIZED (SELECT id, CAST(yd AS DOUBLE) AS y, word_density AS x, yd FROM "
        "(SELECT *, row_number() OVER (ORDER BY yd, k_chars, id) - 1 AS place FROM quality) "
        f"WHERE CAST(place % 2 = 0 AS INTEGER) = {sample})"
    )
    area = auc_of(f"SELECT yd, 1 AS model, round(p, 12) AS score FROM ({logit_rows('logit')})", "model", 5)
    return (
        f"SELECT '{name}' AS sample, c.b0, c.b1, auc FROM (WITH {rows}, {logit_fit(14)} SELECT "
        f"{r('logit.b0', 'b0', 5)}, {r('logit.b1', 'b1', 5)}, a.auc AS auc FROM logit, ({area}) a) c"
    )


# Training rows of the stratified split of the quality frame, with balanced weights.
QUALITY_PARTS = (
    QUALITY_FRAME + ", cut AS ("
    + ORACLES["c8_stratified_split"].split(ORDERS_FRAME, 1)[1].replace("orders_f", "quality")
    + "), parts AS (SELECT quality.*, in_test FROM quality JOIN cut ON cut.id = quality.id), "
    "scaled AS (SELECT *, (word_density - m) / s AS x FROM parts, (SELECT avg(word_density) AS m, "
    "stddev_pop(word_density) AS s FROM parts WHERE in_test = 0)), "
    "fit AS MATERIALIZED (SELECT id, CAST(yd AS DOUBLE) AS y, x, count(*) OVER () / (2.0::DOUBLE * count(*) "
    "OVER (PARTITION BY yd)) AS w FROM scaled WHERE in_test = 0), "
    "held AS (SELECT id, CAST(yd AS DOUBLE) AS y, x FROM scaled WHERE in_test = 1)"
)
LINEAR_PARTS = (
    QUALITY_PARTS + ", lm AS (SELECT avg(k_chars) AS m1, avg(word_density) AS m2, avg(yd) AS my, "
    "var_pop(k_chars) AS s11, var_pop(word_density) AS s22, covar_pop(k_chars, word_density) AS s12, "
    "covar_pop(k_chars, yd) AS s1y, covar_pop(word_density, yd) AS s2y FROM parts WHERE in_test = 0), "
    "lb AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, "
    "(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM lm)"
)
HOLDOUT = (
    QUALITY_FRAME + f", parts AS (SELECT *, CAST({hash_order('id')} <= ceil(0.25 * count(*) OVER ()) AS INTEGER) "
    "AS in_test FROM quality), fit AS MATERIALIZED (SELECT id, CAST(yd AS DOUBLE) AS y, word_density AS x "
    "FROM parts WHERE in_test = 0)"
)


def scored(source: str, digits: int, cut: float = 0.5) -> str:
    return f"SELECT id, {r('z.p', 'score', digits)}, CAST(z.p >= {cut} AS INTEGER) AS said FROM ({source}) z"


add(
    h10_comparison=f"WITH {THREE_FITS}, co AS ("
    f"SELECT model, term, coef, se, {student_p('coef / se', 'df')} AS p FROM ({OLS_ERRORS}), "
    "(SELECT count(*) - 2 AS df FROM fit) UNION ALL "
    f"SELECT *, {normal_p('coef / se')} FROM ({errors(LOGIT_INFO, logit_rows('logit'), 'Logit')} UNION ALL "
    f"{errors(PROBIT_OBSERVED, probit_rows('probit'), 'Probit')})), s AS MATERIALIZED ({scores_sql()}), "
    "sl AS (SELECT CAST(y AS INTEGER) AS yd, 'OLS' AS model, score_ols AS score FROM s UNION ALL "
    "SELECT CAST(y AS INTEGER), 'Logit', score_logit FROM s UNION ALL "
    "SELECT CAST(y AS INTEGER), 'Probit', score_probit FROM s), "
    "ll AS (SELECT sum(ln(CASE WHEN y = 1 THEN score_logit ELSE 1 - score_logit END)) AS l1, "
    "sum(ln(CASE WHEN y = 1 THEN score_probit ELSE 1 - score_probit END)) AS l2, "
    "count(*) * (avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))) AS l0, "
    "-count(*) / 2.0 * (ln(2 * pi() * avg(pow(y - score_ols, 2))) + 1) AS l3, "
    "1 - avg(pow(y - score_ols, 2)) / var_pop(y) AS r2 FROM s), cells AS ("
    f"SELECT model, term, 0 AS line, printf('%.3f', coef) || {STARS} AS text FROM co UNION ALL "
    "SELECT model, term, 1, '(' || printf('%.3f', se) || ')' FROM co UNION ALL "
    "SELECT unnest(['OLS', 'Logit', 'Probit']), 'N', 0, CAST((SELECT count(*) FROM fit) AS VARCHAR) UNION ALL "
    "SELECT unnest(['OLS', 'Logit', 'Probit']), 'R2', 0, "
    "unnest([printf('%.3f', r2), printf('%.3f', 1 - l1 / l0), printf('%.3f', 1 - l2 / l0)]) FROM ll UNION ALL "
    "SELECT unnest(['OLS', 'Logit', 'Probit']), 'loglik', 0, "
    "unnest([printf('%.3f', l3), printf('%.3f', l1), printf('%.3f', l2)]) FROM ll UNION ALL "
    f"SELECT model, 'AUC', 0, printf('%.3f', (c + t / 2) / (p * n)) FROM ({concordance_rows('SELECT * FROM sl', 'model')})) "
    "SELECT term, line, max(text) FILTER (WHERE model = 'OLS') AS \"OLS\", "
    "max(text) FILTER (WHERE model = 'Logit') AS \"Logit\", "
    "max(text) FILTER (WHERE model = 'Probit') AS \"Probit\" FROM cells GROUP BY term, line",
    h11_validation_refit=f"{refit(0, 'train')} UNION ALL {refit(1, 'valid')}",
    i7_penalized_logit=f"WITH {QUALITY_PARTS}, "
    + iterate("pl", logit_rows(), "w * (y - p)", "w * p * (1 - p)", 15, 1.0)
    + " " + scored(logit_rows("pl", "held"), 4),
    i8_probit_estimator=f"WITH {QUALITY_PARTS}, {probit_fit()} " + scored(probit_rows("probit", "held"), 4),
    i9_linear_probability=f"WITH {LINEAR_PARTS} " + scored(
        "SELECT id, greatest(1e-9, least(1 - 1e-9, my + b1 * (k_chars - m1) + b2 * (word_density - m2))) AS p "
        "FROM parts, lb WHERE in_test = 1", 6),
    i10_ridge=f"WITH {QUALITY_PARTS}, rd AS (SELECT *, (sxy - sx * sy / sw) / (sxx - sx * sx / sw + 3.0) AS b1 FROM "
    "(SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * (2 * y - 1)) AS sy, sum(w * x * x) AS sxx, "
    "sum(w * x * (2 * y - 1)) AS sxy FROM fit)) "
    + scored("SELECT id, (sy - b1 * sx) / sw + b1 * x AS p FROM held, rd", 6, 0.0),
    i14_i15_out_of_fold_auc=f"WITH {QUALITY_PARTS}, folds AS (SELECT id, yd, word_density AS x, "
    "CAST(place > round(1 / 3.0::DOUBLE * n) AS INTEGER) + CAST(place > round(2 / 3.0::DOUBLE * n) AS INTEGER) AS fold FROM "
    f"(SELECT *, {hash_order('id', 'yd')} AS place, count(*) OVER (PARTITION BY yd) AS n FROM parts WHERE in_test = 0)), "
    "fb AS (SELECT k AS fold, regr_intercept(yd, x) AS b0, regr_slope(yd, x) AS b1 FROM folds, "
    "(SELECT CAST(i AS INTEGER) AS k FROM range(0, 3) t(i)) WHERE fold <> k GROUP BY k) "
    + auc_of(
        "SELECT fold, yd, round(greatest(1e-9, least(1 - 1e-9, b0 + b1 * x)), 12) AS score FROM folds JOIN fb USING (fold)",
        "fold"),
    i16_train_test_auc=f"WITH {HOLDOUT}, {logit_fit(14)} " + auc_of(
        f"SELECT parts.in_test AS in_test, parts.yd AS yd, round(e.p, 12) AS score FROM "
        f"({logit_rows('logit', '(SELECT id, word_density AS x FROM parts)')}) e JOIN parts ON parts.id = e.id",
        "in_test"),
)


# Model selection over the linear families, on the stratified split and on the systematic one.
SELECTION = f"WITH {QUALITY_PARTS}, " + oracles_search.search(
    "SELECT * FROM parts WHERE in_test = 0", "SELECT * FROM parts WHERE in_test = 1", QUALITY, normal_cdf)
POSITIONS = (
    QUALITY_FRAME + ", spots AS MATERIALIZED (SELECT yd, k_chars, word_density, digit_share, toxic, "
    "row_number() OVER (ORDER BY yd, k_chars, id) - 1 AS id FROM quality), cut AS ("
    + ORACLES["c8_stratified_split"].split(ORDERS_FRAME, 1)[1].replace("orders_f", "spots")
    + "), parts AS MATERIALIZED (SELECT spots.*, in_test FROM spots JOIN cut ON cut.id = spots.id)"
)


def split_winner(name: str, train: str, test: str) -> str:
    source = "SELECT * FROM parts WHERE "
    return (f"(WITH {POSITIONS}, {oracles_search.search(source + train, source + test, QUALITY, normal_cdf)} "
            + oracles_search.best_of(name, concordance_rows) + ")")


SPLITS = (f"SELECT * FROM {split_winner('deterministic', 'id % 2 = 1', 'id % 2 = 0')} UNION ALL "
          f"SELECT * FROM {split_winner('random', 'in_test = 0', 'in_test = 1')}")

add(
    i13_grid_search=f"{SELECTION} {oracles_search.GRID}",
    i15_cross_validated_auc=f"{SELECTION} SELECT model, fold, round(auc, 6) + 0.0 AS auc FROM ("
    + oracles_search.areas("SELECT model, fold, yd, score FROM chosen WHERE sample = 'cv'", "model, fold", concordance_rows)
    + ")",
    i17_leaderboard=f"{SELECTION} {oracles_search.board(concordance_rows)}",
    i18_split_comparison=SPLITS,
    study_comparison=SPLITS,  # no feature of the frame has a gap to fill
    i19_model_rocs=f"{SELECTION} {oracles_search.rocs(concordance_rows)}",
)

ORDER_FIT = ["price", "balance", "quantity", "discount"]
add(**{
    f"{n}_{link}_four_features": f"WITH {ORDERS_FRAME}, "
    + oracles_search.binary_fit("orders_f", ORDER_FIT, link, normal_cdf, normal_p)
    for n, link in (("h2", "logit"), ("h3", "probit"))
})
