"""Model selection over the linear families as SQL: all settings and folds of logit, probit, least squares and ridge."""

from __future__ import annotations

# Settings of the grids and the number of folds.
C = [0.1, 1.0, 3.0]
ALPHA = [0.5, 1.0, 3.0, 10.0]
FOLDS = 5


def values(name: str, column: str, numbers: list[float]) -> str:
    return f"{name} AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in numbers)}]) AS {column})"


def solve(source: str, size: int, keep: str) -> str:
    """Solution x0.. of the symmetric system a00.. = g0.. of each row of `source`, by elimination."""
    sql = source
    for k in range(size - 1):
        out = [keep]
        for i in range(size):
            for j in range(i, size):
                out.append(f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} AS a{i}{j}" if i > k else f"a{i}{j}")
            out.append(f"g{i} - a{k}{i} * g{k} / a{k}{k} AS g{i}" if i > k else f"g{i}")
        sql = f"SELECT {', '.join(out)} FROM ({sql})"
    for i in range(size - 1, -1, -1):
        known = "".join(f" - a{i}{j} * x{j}" for j in range(i + 1, size))
        sql = f"SELECT *, (g{i}{known}) / a{i}{i} AS x{i} FROM ({sql})"
    return sql


def linear_predictor(size: int) -> str:
    return " + ".join(["b0", *[f"b{j} * z{j}" for j in range(1, size)]])


def z(i: int) -> str:
    return f"z{i}" if i else "1"


def sums(size: int, weight: str, pull: str, penalty: str = "0") -> str:
    """Entries of the system of one step: curvature `weight`, slope `pull`, penalty on all but the constant."""
    out = []
    for i in range(size):
        for j in range(i, size):
            extra = f" + {penalty}" if i == j and i else ""
            out.append(f"sum(({weight}) * {z(i)} * {z(j)}){extra} AS a{i}{j}")
        extra = f" - {penalty} * any_value(b{i})" if i and penalty != "0" else ""
        out.append(f"sum(({pull}) * {z(i)}){extra} AS g{i}")
    return ", ".join(out)


def steps(name: str, size: int, start: str, rows: str, weight: str, pull: str, count: int, keys: str, penalty: str = "0") -> str:
    """Newton steps from zero as a chain of tables; `rows` reads the step before as {prior}."""
    b = [f"b{i}" for i in range(size)]
    out = [f"{name}_0 AS MATERIALIZED (SELECT {keys}, {', '.join(f'0::DOUBLE AS {c}' for c in b)} FROM {start})"]
    for n in range(1, count + 1):
        prior = ", ".join(f"any_value({c}) AS {c}" for c in b)
        system = (f"SELECT {keys}, {prior}, {sums(size, weight, pull, penalty)} "
                  f"FROM ({rows.replace('{prior}', f'{name}_{n - 1}')}) GROUP BY {keys}")
        moved = ", ".join(f"b{i} + x{i} AS b{i}" for i in range(size))
        out.append(f"{name}_{n} AS MATERIALIZED (SELECT {keys}, {moved} FROM ({solve(system, size, ', '.join([keys, *b]))}))")
    out.append(f"{name} AS (SELECT * FROM {name}_{count})")
    return ", ".join(out)


def search(train: str, test: str, features: list[str], normal_cdf) -> str:
    """CTEs from tables of (id, yd, features) to `scored`: model, setting, sample, fold, id, yd, score.

    The folds are cut in hash order within each class. `normal_cdf(x)` is a series for the normal distribution.
    """
    size = len(features) + 1
    numbered = list(enumerate(features, 1))
    eta = linear_predictor(size)
    cuts = " + ".join(f"CAST(place > round({i / FOLDS}::DOUBLE * n) AS INTEGER)" for i in range(1, FOLDS))
    place = "row_number() OVER (PARTITION BY yd ORDER BY substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 13), id)"
    scale = ", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i, _ in numbered)
    scores = "id, yd, round({}, 12) AS score"
    probit = (f"SELECT *, 0.5 + d * eta * ({normal_cdf('eta')}) AS p FROM (SELECT *, eta * eta AS x2, "
              "exp(-eta * eta / 2) / sqrt(2 * pi()) AS d FROM (SELECT *, " + eta + " AS eta FROM {}))")
    parts = [
        f"tr AS MATERIALIZED (SELECT id, yd, {', '.join(f'x{i}' for i, _ in numbered)}, {cuts} AS fold FROM "
        f"(SELECT id, yd, {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in numbered)}, {place} AS place, "
        f"count(*) OVER (PARTITION BY yd) AS n FROM ({train})))",
        f"te AS MATERIALIZED (SELECT id, yd, {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in numbered)} FROM ({test}))",
        f"f AS (SELECT CAST(i AS INTEGER) AS f FROM range(-1, {FOLDS}) t(i))",
        values("cs", "c", C), values("alphas", "c", ALPHA),
        "st AS MATERIALIZED (SELECT f, " + ", ".join(
            f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) > 1e-12 THEN stddev_pop(x{i}) ELSE 1 END AS s{i}"
            for i, _ in numbered) + ", count(*) AS n, sum(yd) AS n1 FROM tr JOIN f ON fold <> f GROUP BY f)",
        f"zz AS MATERIALIZED (SELECT f, CAST(yd AS DOUBLE) AS y, {scale}, "
        "n / (2.0 * CASE yd WHEN 1 THEN n1 ELSE n - n1 END)::DOUBLE AS w FROM tr JOIN st ON fold <> f)",
        f"u AS MATERIALIZED (SELECT 'cv' AS sample, f, fold, id, yd, {scale} FROM tr JOIN st ON fold = f UNION ALL "
        f"SELECT 'train', f, -1, id, yd, {scale} FROM tr, st WHERE f = -1 UNION ALL "
        f"SELECT 'test', f, -1, id, yd, {scale} FROM te, st WHERE f = -1)",
        steps("lr", size, "f, cs", f"SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM zz JOIN {{prior}} USING (f)",
              "w * p * (1 - p)", "w * (y - p)", 9, "f, c", "1 / c"),
        steps("pr", size, "f", probit.format("zz JOIN {prior} USING (f)"),
              "d * d / (p * (1 - p))", "(y - p) * d / (p * (1 - p))", 25, "f"),
        f"ls AS MATERIALIZED (SELECT f, {', '.join(f'x{i} AS b{i}' for i in range(size))} FROM ("
        + solve(f"SELECT f, {sums(size, '1', 'y')} FROM zz GROUP BY f", size, "f") + "))",
        f"rg AS MATERIALIZED (SELECT f, c, {', '.join(f'x{i} AS b{i}' for i in range(size))} FROM ("
        + solve("SELECT f, c, " + sums(size, "w", "w * (2 * y - 1)", "c").replace(" - c * any_value", " - 0 * any_value")
                + f" FROM (SELECT *, {', '.join(f'0 AS b{i}' for i in range(size))} FROM zz, alphas) GROUP BY f, c",
                size, "f, c") + "))",
        "scored AS MATERIALIZED ("
        f"SELECT 'logreg' AS model, c AS setting, sample, fold, {scores.format(f'1 / (1 + exp(-({eta})))')} FROM u JOIN lr USING (f) "
        f"UNION ALL SELECT 'probit', NULL, sample, fold, {scores.format('greatest(1e-9, least(1 - 1e-9, p))')} FROM ("
        + probit.format("u JOIN pr USING (f)") + ") "
        f"UNION ALL SELECT 'ols', NULL, sample, fold, {scores.format(f'greatest(1e-9, least(1 - 1e-9, {eta}))')} FROM u JOIN ls USING (f) "
        f"UNION ALL SELECT 'ridge', c, sample, fold, {scores.format(eta)} FROM u JOIN rg USING (f))",
        "grid AS MATERIALIZED (SELECT model, setting, avg(accuracy) AS accuracy, row_number() OVER "
        "(PARTITION BY model ORDER BY round(avg(accuracy), 12) DESC, setting) = 1 AS best FROM (SELECT model, setting, fold, "
        "avg(CAST((score >= CASE model WHEN 'ridge' THEN 0 ELSE 0.5 END) = (yd = 1) AS INTEGER)) AS accuracy "
        "FROM scored WHERE sample = 'cv' GROUP BY ALL) GROUP BY model, setting)",
        "chosen AS MATERIALIZED (SELECT s.* FROM scored s JOIN grid g ON s.model = g.model "
        "AND s.setting IS NOT DISTINCT FROM g.setting WHERE best)",
    ]
    return ", ".join(parts)


SETTINGS = "coalesce(CASE model WHEN 'logreg' THEN 'C=' WHEN 'ridge' THEN 'alpha=' END || CAST(setting AS VARCHAR), '')"
GRID = f"SELECT model, {SETTINGS} AS settings, round(accuracy, 6) AS accuracy, best FROM grid"


def areas(source: str, by: str, concordance_rows) -> str:
    return (f"SELECT {by}, CASE WHEN p * n > 0 THEN (c + t / 2) / (p * n) END AS auc "
            f"FROM ({concordance_rows(source, by)})")


def board(concordance_rows) -> str:
    each = areas("SELECT model, sample, fold, yd, score FROM chosen", "model, sample, fold", concordance_rows)
    means = ", ".join(f"round(avg(auc) FILTER (WHERE sample = '{s}'), 6) + 0.0 AS {s}_auc" for s in ("cv", "train", "test"))
    return (f"SELECT b.*, {SETTINGS.replace('model', 'b.model')} AS best_params FROM "
            f"(SELECT model, {means} FROM ({each}) GROUP BY model) b JOIN grid g ON b.model = g.model AND g.best")


def rocs(concordance_rows) -> str:
    """Corners of the ROC curves of the held-out rows, from (0, 0), and the areas."""
    held = "SELECT model, yd, score FROM chosen WHERE sample = 'test'"
    return (
        "SELECT model, round(threshold, 6) + 0.0 AS threshold, round(fpr, 6) + 0.0 AS fpr, round(tpr, 6) + 0.0 AS tpr, "
        "round(auc, 6) + 0.0 AS auc FROM (SELECT model, threshold, sum(neg) OVER up / sum(neg) OVER whole AS fpr, "
        "sum(pos) OVER up / sum(pos) OVER whole AS tpr, "
        "lead(pos) OVER down IS NULL OR lead(pos) OVER down <> pos OR lead(neg) OVER down <> neg "
        "OR row_number() OVER down = 1 AS corner FROM (SELECT model, score AS threshold, sum(yd) AS pos, "
        f"sum(1 - yd) AS neg FROM ({held}) GROUP BY ALL) WINDOW whole AS (PARTITION BY model), "
        "down AS (PARTITION BY model ORDER BY threshold DESC), up AS (PARTITION BY model ORDER BY threshold DESC "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0, 0, TRUE "
        f"FROM ({held})) JOIN ({areas(held, 'model', concordance_rows)}) USING (model) WHERE corner")


def best_of(name: str, concordance_rows) -> str:
    return (f"SELECT '{name}' AS split, model AS best_model, train_auc, test_auc FROM ({board(concordance_rows)}) "
            "ORDER BY test_auc DESC NULLS LAST, model LIMIT 1")


def binary_fit(frame: str, features: list[str], link: str, normal_cdf, normal_p, digits: int = 4) -> str:
    """Coefficients, standard errors by the observed information, tests and intervals of a logit or probit."""
    size, name = len(features) + 1, link.capitalize()
    eta = linear_predictor(size)
    known = " AND ".join(f"{c} IS NOT NULL" for c in features)
    columns = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(features, 1))
    if link == "logit":
        rows = f"SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM zz, {{prior}}"
        weight, pull, observed, count = "p * (1 - p)", "y - p", "p * (1 - p)", 9
    else:
        rows = (f"SELECT *, 0.5 + d * eta * ({normal_cdf('eta')}) AS p FROM (SELECT *, eta * eta AS x2, "
                f"exp(-eta * eta / 2) / sqrt(2 * pi()) AS d FROM (SELECT *, {eta} AS eta FROM zz, {{prior}}))")
        weight, pull, count = "d * d / (p * (1 - p))", "(y - p) * d / (p * (1 - p))", 9
        own = "CASE WHEN y = 1 THEN d / p ELSE -d / (1 - p) END"
        observed = f"({own}) * (({own}) + eta)"
    entries = ", ".join(f"sum(({observed}) * {z(i)} * {z(j)}) AS a{i}{j}" for i in range(size) for j in range(i, size))
    prior = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(size))
    keep = ", ".join(["t", *[f"b{i}" for i in range(size)], *[f"m{i}" for i in range(1, size)], *[f"s{i}" for i in range(1, size)]])
    # Terms on the columns as they are: row t of the change of coordinates is the right-hand side.
    unit = ", ".join(
        (f"CASE t WHEN 0 THEN {'1' if i == 0 else f'-m{i} / s{i}'} WHEN {i} THEN "
         + ("1" if i == 0 else f"1 / s{i}") + f" ELSE 0 END::DOUBLE AS g{i}") for i in range(size))
    combined = " + ".join(
        f"(CASE t WHEN 0 THEN {'1' if i == 0 else f'-m{i} / s{i}'} WHEN {i} THEN "
        + ("1" if i == 0 else f"1 / s{i}") + f" ELSE 0 END) * {{}}{i}" for i in range(size))
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(features, 1))
    system = f"SELECT *, {unit} FROM info, mom, (SELECT CAST(i AS INTEGER) AS t FROM range(0, {size}) q(i))"
    terms = "[" + ", ".join(f"'{c}'" for c in ["const", *features]) + "]"
    far = "1.959963984540054"
    out = ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for e, n in (
        ("coef", "coef"), ("se", "std_err"), ("coef / se", "statistic"), (normal_p("coef / se"), "p_value"),
        (f"coef - {far} * se", "ci_low"), (f"coef + {far} * se", "ci_high")))
    return (
        f"clean AS MATERIALIZED (SELECT id, CAST(yd AS DOUBLE) AS y, {', '.join(features)} FROM {frame} WHERE yd IS NOT NULL AND {known}), "
        f"mom AS MATERIALIZED (SELECT {moments} FROM clean), "
        f"zz AS MATERIALIZED (SELECT 0 AS f, y, {columns} FROM clean), one AS (SELECT 0 AS k), "
        + steps("nw", size, "one", rows, weight, pull, count, "k")
        + f", info AS MATERIALIZED (SELECT {prior}, {entries} FROM ({rows.replace('{prior}', 'nw')})) "
        f"SELECT '{name}' AS model, {terms}[t + 1] AS term, {out} FROM (SELECT t, {combined.replace('{}', 'b')} AS coef, "
        f"sqrt({combined.replace('{}', 'x')}) AS se FROM ({solve(system, size, keep)}))")
