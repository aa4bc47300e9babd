"""The registered queries in plain SQL, for an independent check of their results."""

from __future__ import annotations

from itertools import combinations

from regiometric import fixed
from workloads import standins as st

_STATES = ", ".join(f"({i}, '{code}', '{name}')" for i, (code, name) in enumerate(fixed.STATES.items()))
_MACROS = ", ".join(f"({i}, '{name}', {number})" for i, (name, number) in enumerate(fixed.MACRO_REGION_ORDER.items()))
_BEDS = ", ".join(f"'{code}'" for code in fixed.INTENSIVE_CARE_BEDS)
_CAPITALS = ", ".join(f"'{code}'" for code in st.CAPITALS)
_OVERRIDES = ", ".join(f"'{code}'" for code in st.OVERRIDE_REGIONS)
_UNITS = ", ".join(f"('{code}', '{label}')" for code, label in st.UNIT_LABELS.items())
_DF = fixed.FEDERAL_DISTRICT

_MUNICIPALITY = "CAST(100000 + l_suppkey * 10 + l_linenumber AS VARCHAR)"
_CHECKED = f"{_MUNICIPALITY} || CAST(l_suppkey % 10 AS VARCHAR)"
_SHARE = "CAST((n * 20000 + total) // (2 * total) AS DOUBLE) / 100"  # n / total in percent, two places, half up

_CTES = {
    "states": f"SELECT * FROM (VALUES {_STATES}) AS v(k, sigla, nome)",
    "macros": f"SELECT * FROM (VALUES {_MACROS}) AS v(k, nome, numero)",
    "regions": """
        SELECT s_suppkey, s_acctbal, CAST(10000 + s_suppkey AS VARCHAR) AS cod_regsaud, s_name AS regiao_saude,
               st.sigla AS uf_sigla, st.nome AS uf, CAST(11 + n_nationkey AS VARCHAR) AS cod_uf, m.nome AS regiao,
               m.numero
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        JOIN states st ON st.k = n_nationkey JOIN macros m ON m.k = r_regionkey""",
    "hierarchy": """
        SELECT CAST(100000 + s_suppkey * 10 + j AS VARCHAR) AS cod_municipio,
               CAST(100000 + s_suppkey * 10 + j AS VARCHAR) || CAST(s_suppkey % 10 AS VARCHAR) AS cod_municipiodv,
               regiao_saude || '-' || CAST(j AS VARCHAR) AS municipio, s_suppkey, j,
               cod_regsaud, regiao_saude, uf_sigla, uf, cod_uf, regiao
        FROM regions CROSS JOIN (SELECT UNNEST(range(1, 7)) AS j)""",
    "registry": f"""
        SELECT strftime(o_orderdate, '%Y%m') AS period,
               CASE WHEN o_orderstatus = 'P' THEN {_CHECKED} ELSE {_MUNICIPALITY} END AS code,
               CAST(o_custkey AS VARCHAR) AS person, l_linestatus = 'O' AS nurse,
               CASE WHEN l_tax = 0 THEN NULL WHEN l_tax = 0.08 THEN '100100'
                    ELSE '0' || o_orderpriority[1] || '0'
                         || CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END || '00' END AS bond
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "nurses": "SELECT * FROM registry WHERE nurse",
    # a bond code is 0 + priority 1..5 + 0 + 1..3, or 100100, or missing
    "bonds": f"""
        SELECT *, CASE WHEN bond IN ('010100', '010200', '100100') THEN '{fixed.BOND_PROTECTED}'
                       WHEN bond = '040300' OR bond[1:2] = '05' THEN '{fixed.BOND_OTHER}'
                       WHEN bond IS NOT NULL THEN '{fixed.BOND_PRECARIOUS}'
                       ELSE '{fixed.BOND_UNKNOWN}' END AS class
        FROM nurses""",
    "placed": "SELECT n.*, h.cod_regsaud, h.regiao_saude FROM bonds n LEFT JOIN hierarchy h ON n.code = h.cod_municipio",
    "placed6": """
        SELECT n.*, h.cod_regsaud, h.regiao_saude FROM bonds n LEFT JOIN hierarchy h ON n.code[1:6] = h.cod_municipio""",
    "heads": "SELECT cod_regsaud, COUNT(DISTINCT person) AS TOTAL_PROF FROM placed GROUP BY ALL",
    "jobs": """
        SELECT cod_regsaud, regiao_saude, ROUND(CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT person), 4) AS vinc_medio
        FROM placed GROUP BY ALL""",
    "people": """
        SELECT CASE WHEN s_suppkey % 7 = 0 THEN '9' ELSE '' END || CAST(10000 + s_suppkey AS VARCHAR) AS cod_regsaud,
               CAST(floor(abs(s_acctbal)) AS BIGINT) + 2000 AS populacao
        FROM supplier""",
    "lines": f"""
        SELECT *, {_MUNICIPALITY} AS code, {_CHECKED} AS codedv, year(l_shipdate) AS ano,
               strftime(l_shipdate, '%Y%m') AS period
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "lines_placed": """
        SELECT l.*, h.cod_regsaud, h.regiao_saude, h.uf_sigla
        FROM lines l LEFT JOIN hierarchy h ON l.code = h.cod_municipio""",
    "lines_region": "SELECT l.*, r.* FROM lines l JOIN regions r ON l.l_suppkey = r.s_suppkey",
    "units": f"SELECT * FROM (VALUES {_UNITS}) AS v(tipo, descricao)",
    "distances": """
        SELECT cod_municipio, cod_regsaud, regiao_saude, abs(s_acctbal) / 4 + j AS km,
               CASE WHEN s_acctbal > j * 1500 THEN 'sim' ELSE 'não' END AS road
        FROM hierarchy h JOIN supplier s ON h.s_suppkey = s.s_suppkey""",
    "access": """
        SELECT cod_regsaud, regiao_saude, ROUND(AVG(km), 4) AS dist_media_capital_km,
               COUNT(*) FILTER (road = 'sim') AS n, COUNT(*) AS total
        FROM distances GROUP BY ALL""",
    "gdp": """
        SELECT cod_regsaud, regiao_saude, ano, l_extendedprice AS v, p_size = 50 AND month(l_shipdate) = 1 AS rare,
               l_quantity = 50 AS dry
        FROM lines_placed""",
    "rates": """
        SELECT CAST(10000 + l_suppkey AS VARCHAR) AS code, COUNT(*) FILTER (l_returnflag <> 'R') AS k, COUNT(*) AS n,
               CAST(COUNT(*) FILTER (l_returnflag <> 'R') AS DOUBLE) / COUNT(*) AS rate
        FROM lineitem GROUP BY ALL""",
    "enriched": "SELECT * FROM rates LEFT JOIN regions ON code = cod_regsaud",
    "gaps": "SELECT * REPLACE (CASE WHEN rate <= 0.69 THEN rate END AS rate) FROM enriched",
    "two_places": """
        SELECT regiao, uf, regiao_saude AS nome_regiao_saude, code, (200 * k + n) // (2 * n) AS percent FROM enriched""",
    "hinges": """
        SELECT regiao, COUNT(*) AS n, quantile_cont(rate, 0.25) AS q1, quantile_cont(rate, 0.5) AS median,
               quantile_cont(rate, 0.75) AS q3
        FROM enriched GROUP BY ALL""",
    "occupation": """
        SELECT CAST(10000 + l_suppkey AS VARCHAR) AS code, o_orderpriority AS p,
               CAST(COUNT(*) FILTER (l_returnflag <> 'R') AS DOUBLE) / COUNT(*) AS rate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "wide": f"""
        SELECT a.code AS regiao_saude, {", ".join(f"r{i}.rate AS {name}" for i, name in enumerate(st.OCCUPATIONS))},
               g.uf, g.regiao
        FROM (SELECT DISTINCT code FROM occupation WHERE p = '1-URGENT') a
        {" ".join(
            f"LEFT JOIN occupation r{i} ON r{i}.p = '{p}' AND a.code = "
            + (f"CASE WHEN CAST(r{i}.code AS INTEGER) % 7 = {i} THEN '9' ELSE '' END || " if i else "") + f"r{i}.code"
            for i, p in enumerate(st.OCCUPATIONS.values())
        )}
        LEFT JOIN regions g ON g.cod_regsaud = a.code""",
    "densities": f"""
        SELECT st.nome AS UF, st.sigla,
               {", ".join(
                   f"MAX(CASE WHEN seg = '{seg}' THEN razao END) AS {name}" for seg, name in st.DENSITIES.items()
               )}
        FROM (SELECT c_nationkey AS k, c_mktsegment AS seg,
                     CAST(COUNT(*) AS DOUBLE) / MAX(people) * 1000 AS razao
              FROM customer JOIN (SELECT c_nationkey AS kk, SUM(c_custkey % 97) + 1000 AS people
                                  FROM customer GROUP BY ALL) ON kk = c_nationkey
              GROUP BY ALL) d JOIN states st ON st.k = d.k
        GROUP BY ALL""",
    "state_table": f"""
        SELECT COALESCE(st.sigla, m.uf) AS uf, m.regiao, {", ".join(f"m.{name}" for name in st.OCCUPATIONS)},
               {", ".join(f"d.{name}" for name in st.DENSITIES.values())}
        FROM (SELECT uf, regiao, {", ".join(
            f"CASE WHEN COUNT(*) = COUNT({name}) THEN median({name}) END AS {name}" for name in st.OCCUPATIONS
        )} FROM wide GROUP BY ALL) m
        LEFT JOIN densities d ON d.UF = m.uf LEFT JOIN states st ON st.nome = m.uf""",
    "density": """
        SELECT CAST(11 + c_nationkey AS VARCHAR) AS cod_uf, MAX(sigla) AS sigla, AVG(c_acctbal / 1000) AS razao
        FROM customer JOIN states ON k = c_nationkey GROUP BY ALL""",
    "points": f"""
        SELECT d.cod_uf, d.sigla, d.razao, e.uf, e.regiao, AVG(rate) AS m, median(rate) AS med
        FROM density d JOIN enriched e ON e.cod_uf = d.cod_uf WHERE e.uf <> '{_DF}' GROUP BY ALL""",
    "line": "SELECT regr_slope(razao, m) AS b, regr_intercept(razao, m) AS a FROM points",
    "complete": """
        SELECT rate_medicos AS y, rate_enfermeiros AS x1, rate_dentista AS x2, rate_tec_aux_enf AS x3
        FROM wide WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL""",
    "two": """
        SELECT regiao, rate_medicos AS y, rate_enfermeiros AS x1, rate_dentista AS x2
        FROM wide WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL""",
    "states_two": f"""
        SELECT 'all' AS regiao, razao_medicos AS y, razao_enfermeiros AS x1, razao_dentistas AS x2
        FROM state_table WHERE uf <> '{fixed.FEDERAL_DISTRICT_CODE}' AND y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL""",
}

# what each named table above is built from
_NEEDS = {
    "regions": ["states", "macros"], "hierarchy": ["regions"], "nurses": ["registry"], "bonds": ["nurses"],
    "placed": ["bonds", "hierarchy"], "placed6": ["bonds", "hierarchy"], "heads": ["placed"], "jobs": ["placed"],
    "lines_placed": ["lines", "hierarchy"], "lines_region": ["lines", "regions"], "distances": ["hierarchy"],
    "access": ["distances"], "gdp": ["lines_placed"], "enriched": ["rates", "regions"], "gaps": ["enriched"],
    "two_places": ["enriched"], "hinges": ["enriched"], "wide": ["occupation", "regions"], "densities": ["states"],
    "state_table": ["wide", "densities", "states"], "density": ["states"], "points": ["density", "enriched"],
    "line": ["points"], "complete": ["wide"], "two": ["wide"], "states_two": ["state_table"],
}


def _with(names: str, body: str, **extra: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    tables = [f"{name} AS ({_CTES[name]})" for name in order] + [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(tables)} {body}"


def _rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"ROUND({name}, {digits}) AS {name}" for name in names)


def _share_by_class(copies: str = "1", where: str = "true") -> str:
    return _with(
        "placed6",
        f"""SELECT cod_regsaud, regiao_saude, class AS categorias_vinculos, n, {_SHARE} AS percentual
            FROM (SELECT *, CAST(SUM(n) OVER (PARTITION BY cod_regsaud, regiao_saude) AS BIGINT) AS total
                  FROM (SELECT cod_regsaud, regiao_saude, class, CAST(SUM({copies}) AS BIGINT) AS n
                        FROM placed6 WHERE {where} GROUP BY ALL))""",
    )


# two-sided p-value of t with whole df: finite series of the t distribution, one form for even and one for odd df
def _p_value(t: str, df: str) -> str:
    angle = f"atan(abs({t}) / sqrt({df}))"

    def series(first: int, last: str) -> str:
        # sum over m of the running product of (2i - 1) / (2i), or 2i / (2i + 1), times a power of the cosine
        ratio = "(2 * i - 1) / (2 * i)" if first else "(2 * i) / (2 * i + 1)"
        product = f"list_product(list_transform(range(1, m + 1), lambda i: CAST({ratio} AS DOUBLE)))"
        return (
            f"list_sum(list_transform(range(0, {last}), lambda m: COALESCE({product}, 1) * pow(cos({angle}), 2 * m)))"
        )

    even = f"sin({angle}) * {series(1, f'CAST({df} // 2 AS BIGINT)')}"
    odd = f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {series(0, f'CAST(({df} - 1) // 2 AS BIGINT)')})"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def _model() -> str:
    """Coefficients from residuals: a term's coefficient is the slope of y on what the other terms leave of it."""
    parts = []
    for j, (x, u, v) in enumerate([("x1", "x2", "x3"), ("x2", "x1", "x3"), ("x3", "x1", "x2")]):
        # take u out of x and v, then what is left of v out of x
        parts.append(
            f"""SELECT {j + 1} AS j, regr_slope(y, e) AS b, regr_sxx(y, e) AS sxx FROM (
                  SELECT y, xr - (SELECT regr_slope(xr, vr) FROM q{j}) * vr AS e FROM q{j})"""
        )
    q = {
        f"q{j}": f"""SELECT y, x - lx.a - lx.b * u AS xr, v - lv.a - lv.b * u AS vr
                     FROM (SELECT y, {x} AS x, {u} AS u, {v} AS v FROM complete),
                          (SELECT regr_intercept({x}, {u}) AS a, regr_slope({x}, {u}) AS b FROM complete) lx,
                          (SELECT regr_intercept({v}, {u}) AS a, regr_slope({v}, {u}) AS b FROM complete) lv"""
        for j, (x, u, v) in enumerate([("x1", "x2", "x3"), ("x2", "x1", "x3"), ("x3", "x1", "x2")])
    }
    # the intercept is the coefficient of the constant, so the constant is residualised on the three others likewise
    extra = q | {
        "slopes": " UNION ALL ".join(parts),
        "b": "SELECT MAX(b) FILTER (j = 1) AS b1, MAX(b) FILTER (j = 2) AS b2, MAX(b) FILTER (j = 3) AS b3 FROM slopes",
        "i0": "SELECT AVG(y) - b1 * AVG(x1) - b2 * AVG(x2) - b3 * AVG(x3) AS b0 FROM complete, b GROUP BY b1, b2, b3",
        "fit": """SELECT COUNT(*) AS n, COUNT(*) - 4 AS df, SUM((y - b0 - b1 * x1 - b2 * x2 - b3 * x3) ** 2) AS sse,
                         regr_sxx(x1, y) AS sst FROM complete, b, i0""",
        "c1": "SELECT x1, x2, x3, 1 - x1 * (SELECT SUM(x1) / SUM(x1 * x1) FROM complete) AS c FROM complete",
        "d1": """SELECT x1, c, x2 - x1 * (SELECT SUM(x1 * x2) / SUM(x1 * x1) FROM complete) AS x2,
                        x3 - x1 * (SELECT SUM(x1 * x3) / SUM(x1 * x1) FROM complete) AS x3 FROM c1""",
        "d2": """SELECT c - x2 * (SELECT SUM(c * x2) / SUM(x2 * x2) FROM d1) AS c,
                        x3 - x2 * (SELECT SUM(x3 * x2) / SUM(x2 * x2) FROM d1) AS x3 FROM d1""",
        "d3": "SELECT SUM((c - x3 * (SELECT SUM(c * x3) / SUM(x3 * x3) FROM d2)) ** 2) AS scc FROM d2",
        "terms": """SELECT '(Intercept)' AS term, b0 AS estimate, scc AS sxx FROM i0, d3
                    UNION ALL SELECT CASE j WHEN 1 THEN 'rate_enfermeiros' WHEN 2 THEN 'rate_dentista'
                                     ELSE 'rate_tec_aux_enf' END, b, sxx FROM slopes""",
        "tested": """SELECT term, estimate, sqrt(sse / df / sxx) AS std_error, estimate / sqrt(sse / df / sxx) AS t_value,
                            n, df AS df_residual, 1 - sse / sst AS r2, 1 - (sse / df) / (sst / (n - 1)) AS r2_adjusted,
                            sqrt(sse / df) AS residual_error, ((sst - sse) / 3) / (sse / df) AS f_value
                     FROM terms, fit""",
    }
    figures = ["estimate", "std_error", "t_value", "r2", "r2_adjusted", "residual_error", "f_value"]
    return _with(
        "complete",
        f"""SELECT term, n, df_residual, {_rounded(figures, 5)},
                   ROUND({_p_value("t_value", "df_residual")}, 5) AS p_value,
                   ROUND({_p_value("sqrt(3 * f_value)", "df_residual")} + pow(1 + 3 * f_value / df_residual, -df_residual / 2)
                         * sqrt(3 * f_value / (df_residual + 3 * f_value))
                         * 2 * exp(lgamma(df_residual / 2 + 0.5) - lgamma(df_residual / 2) - lgamma(0.5)), 5) AS f_p_value
            FROM tested""",
        **extra,
    )


def _pair_model(source: str, tables: str, body: str) -> str:
    """Models of y on x1 and x2 per ``regiao`` of ``source``, by taking x1 out of x2 and y."""
    extra = {
        "m": f"""SELECT regiao, COUNT(*) AS n, AVG(y) AS my, AVG(x1) AS m1, AVG(x2) AS m2, covar_pop(x1, x1) AS s11,
                        covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS s1y,
                        covar_pop(x2, y) AS s2y, covar_pop(y, y) AS syy FROM {source} GROUP BY ALL""",
        "e": """SELECT *, s11 > 0 AS u1, CASE WHEN s11 > 0 THEN s12 / s11 ELSE 0 END AS g FROM m""",
        "e2": """SELECT *, s22 - g * s12 AS e22, s2y - g * s1y AS e2y, s22 - g * s12 > 1e-12 * s22 AS u2 FROM e""",
        "b": """SELECT *, CASE WHEN u2 THEN e2y / e22 END AS b2,
                       CASE WHEN u1 THEN s1y / s11 - g * CASE WHEN u2 THEN e2y / e22 ELSE 0 END END AS b1,
                       n - 1 - CAST(u1 AS INTEGER) - CAST(u2 AS INTEGER) AS df, CAST(u1 AS INTEGER) + CAST(u2 AS INTEGER) AS k,
                       CASE WHEN u2 THEN 1 / (n * e22) ELSE 0 END AS i22, n * syy AS tss,
                       n * greatest(0, syy - CASE WHEN u1 THEN s1y * s1y / s11 ELSE 0 END
                                       - CASE WHEN u2 THEN e2y * e2y / e22 ELSE 0 END) AS rss FROM e2""",
        "b0": """SELECT *, my - COALESCE(b1, 0) * m1 - COALESCE(b2, 0) * m2 AS b0, -g * i22 AS i12,
                        CASE WHEN u1 THEN 1 / (n * s11) + g * g * i22 ELSE 0 END AS i11,
                        CASE WHEN df > 0 AND tss > 0 THEN rss / df END AS s2, CASE WHEN tss > 0 THEN 1 - rss / tss END AS r2
                 FROM b""",
        "t": """SELECT *, UNNEST(['(Intercept)', 'x1', 'x2']) AS term, UNNEST([b0, b1, b2]) AS estimate,
                       UNNEST([sqrt(s2 * (1.0 / n + m1 * m1 * i11 + 2 * m1 * m2 * i12 + m2 * m2 * i22)),
                               CASE WHEN u1 THEN sqrt(s2 * i11) END, CASE WHEN u2 THEN sqrt(s2 * i22) END]) AS std_error,
                       CASE WHEN df > 0 AND k > 0 AND r2 < 1 THEN (r2 / k) / ((1 - r2) / df) END AS f_value
                FROM b0""",
        "tt": "SELECT *, CASE WHEN std_error > 0 THEN estimate / std_error END AS t_value FROM t",
    }
    return _with(tables, body, **extra)


def _pair_terms(source: str, names: tuple[str, str], grouped: bool) -> str:
    x1, x2 = names
    return _pair_model(
        source, source,
        f"""SELECT {"regiao, " if grouped else ""}replace(replace(term, 'x1', '{x1}'), 'x2', '{x2}') AS term, n,
                   CAST(df AS BIGINT) AS df_residual, {_rounded(["estimate", "std_error", "t_value", "r2", "f_value"], 5)},
                   CASE WHEN df > 0 THEN ROUND(1 - (1 - r2) * (n - 1) / df, 5) END AS r2_adjusted,
                   CASE WHEN df > 0 THEN ROUND(sqrt(rss / df), 5) END AS residual_error,
                   CASE WHEN t_value IS NOT NULL THEN ROUND({_p_value("t_value", "df")}, 5) END AS p_value,
                   ROUND(CASE WHEN f_value IS NULL THEN NULL WHEN k = 2 THEN pow(1 + 2 * f_value / df, -df / 2)
                              ELSE {_p_value("sqrt(f_value)", "df")} END, 5) AS f_p_value
            FROM tt""",
    )


_FIVE = ", ".join(
    f"ROUND({what}, 6) + 0.0::DOUBLE AS {name}"
    for name, what in {
        "min": "MIN(r)", "q1": "quantile_cont(r, 0.25)", "median": "quantile_cont(r, 0.5)",
        "q3": "quantile_cont(r, 0.75)", "max": "MAX(r)",
    }.items()
)


def _model_rows(body: str) -> str:
    """Fitted values and leverage of the model of three features, by taking each feature out of the later ones."""
    return _with(
        "wide",
        body,
        given="""SELECT regiao_saude, rate_medicos AS y, rate_enfermeiros AS x1, rate_dentista AS x2, rate_tec_aux_enf AS x3
                 FROM wide WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL""",
        e0="""SELECT regiao_saude, y, AVG(y) OVER () AS my, COUNT(*) OVER () AS n, x1 - AVG(x1) OVER () AS e1,
                     x2 - AVG(x2) OVER () AS x2, x3 - AVG(x3) OVER () AS x3 FROM given""",
        e1="""SELECT *, x2 - e1 * (SUM(e1 * x2) OVER () / SUM(e1 * e1) OVER ()) AS e2,
                     x3 - e1 * (SUM(e1 * x3) OVER () / SUM(e1 * e1) OVER ()) AS r3 FROM e0""",
        e2="SELECT *, r3 - e2 * (SUM(e2 * r3) OVER () / SUM(e2 * e2) OVER ()) AS e3 FROM e1",
        fits="""SELECT regiao_saude, y, my + e1 * SUM(e1 * y) OVER () / SUM(e1 * e1) OVER ()
                         + e2 * SUM(e2 * y) OVER () / SUM(e2 * e2) OVER ()
                         + e3 * SUM(e3 * y) OVER () / SUM(e3 * e3) OVER () AS fitted,
                       1.0 / n + e1 * e1 / SUM(e1 * e1) OVER () + e2 * e2 / SUM(e2 * e2) OVER ()
                         + e3 * e3 / SUM(e3 * e3) OVER () AS leverage FROM e2""",
        left_over="SELECT *, y - fitted AS r FROM fits",
    )


_BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]
_OCC, _DEN = list(st.OCCUPATIONS), list(st.DENSITIES.values())
_PAIRS = list(combinations(_OCC, 2))


def _box(rows: str, by: str, value: str, tables: str, order: str = "") -> str:
    return _with(
        tables,
        f"""SELECT b.{by}, MAX(h.n) AS n, {", ".join(f"ROUND(MAX(h.{q}), 6) AS {q}" for q in _BOX[:3])},
                   ROUND(MIN(v) FILTER (v BETWEEN lo AND hi), 6) AS whisker_low,
                   ROUND(MAX(v) FILTER (v BETWEEN lo AND hi), 6) AS whisker_high,
                   COUNT(*) FILTER (NOT v BETWEEN lo AND hi) AS n_outliers{", CAST(MAX(o.ord) AS INTEGER) AS ord" if order else ""}
            FROM b JOIN h ON b.{by} = h.{by} {order} GROUP BY ALL""",
        b=rows,
        h=f"""SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
                SELECT {by}, COUNT(*) AS n, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
                       quantile_cont({value}, 0.75) AS q3 FROM b GROUP BY ALL)""",
    )


def _pair_rows(select: str) -> str:
    return " UNION ALL ".join(select.format(x=x, y=y) for x, y in _PAIRS)


_MART_TYPES = ", ".join(
    f"CAST(SUM(CASE WHEN descricao = '{label}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{name}\""
    for label, name in fixed.UNIT_TYPES.items()
)


def _mart(spelled: bool = False) -> str:
    period = f"{st.YEAR}{st.MONTH:02d}"
    extra = {
        "nu": f"SELECT * FROM bonds WHERE period = '{period}'",
        "ex": "SELECT n.*, cod_regsaud, regiao_saude FROM nu n JOIN hierarchy ON code = cod_municipio",
        "px": "SELECT n.*, cod_regsaud, regiao_saude FROM nu n JOIN hierarchy ON code[1:6] = cod_municipio",
        "b": "SELECT cod_regsaud AS r, populacao AS pop_censo22 FROM people",
        "c": f"""SELECT cod_regsaud AS r, uf_sigla, CAST(SUM(l_quantity) AS BIGINT) AS internacoes_sensiveis_aps
                 FROM lines_placed WHERE ano = {st.YEAR} GROUP BY ALL""",
        "e": f"""SELECT cod_regsaud AS r, COUNT(DISTINCT l_partkey) AS total_ies_enfermagem,
                        CAST(SUM(l_quantity) AS BIGINT) AS matriculas_ies, CAST(SUM(l_linenumber) AS BIGINT)
                        AS ingressos_ies, CAST(SUM(p_size) AS BIGINT) AS vagas_ies,
                        CAST(SUM(l_quantity * 2) AS BIGINT) AS inscritos_ies
                 FROM lines_region WHERE ano = {st.YEAR} AND p_type = '{st.COURSE}' GROUP BY ALL""",
        "f": f"""SELECT cod_regsaud AS r, CAST(SUM(l_quantity) AS BIGINT) AS Leitos_UTI_SUS,
                        CAST(SUM(l_linenumber) AS BIGINT) AS Leitos_UTI_NSUS
                 FROM lines_placed WHERE period = '{period}' AND CAST(60 + l_partkey % 30 AS VARCHAR) IN ({_BEDS})
                 GROUP BY ALL""",
        "g": f"""SELECT cod_regsaud AS r, CAST(SUM(l_quantity) AS BIGINT) AS quant_leitos_sus,
                        CAST(SUM(l_linenumber) AS BIGINT) AS quant_leitos_n_sus
                 FROM lines_region WHERE ano = {st.YEAR} GROUP BY ALL""",
        "h": f"""SELECT cod_regsaud AS r, regiao_saude, {_MART_TYPES}
                 FROM lines_placed LEFT JOIN units ON p_type = tipo WHERE period = '{period}' GROUP BY ALL""",
        "i": "SELECT cod_regsaud AS r, COUNT(DISTINCT person) AS TOTAL_PROF FROM ex GROUP BY ALL",
        "j": f"""SELECT r, CASE WHEN n > 0 THEN {_SHARE} END AS percentual_precarizacao FROM (
                   SELECT cod_regsaud AS r, COUNT(*) FILTER (class = '{fixed.BOND_PRECARIOUS}') AS n, COUNT(*) AS total
                   FROM px GROUP BY ALL)""",
        "l": f"""SELECT cod_regsaud AS r, dist_media_capital_km, CASE WHEN n > 0 THEN {_SHARE} END AS road FROM access""",
        "n": f"""SELECT CAST(10000 + l_suppkey AS VARCHAR) AS r, COUNT(*) AS obitos_homicidios
                 FROM lines WHERE ano = {st.YEAR} AND l_returnflag = 'R' GROUP BY ALL""",
        "o": """SELECT cod_regsaud AS r, ROUND(CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT person), 4) AS vinc_medio
                FROM ex GROUP BY ALL""",
        "p": f"""SELECT r, PIB_1000, CASE WHEN n1 > 0 THEN {_SHARE.replace("n *", "n1 *")} ELSE 0 END AS amazonia,
                        CASE WHEN n2 > 0 THEN {_SHARE.replace("n *", "n2 *")} ELSE 0 END AS semiarido
                 FROM (SELECT cod_regsaud AS r, ROUND(SUM(v), 4) AS PIB_1000, COUNT(*) FILTER (rare) AS n1,
                              COUNT(*) FILTER (dry) AS n2, COUNT(*) AS total
                       FROM gdp WHERE ano = {st.GDP_YEAR} GROUP BY ALL)""",
    }
    if spelled:
        name = "CASE WHEN s_suppkey % 5 = 0 AND l_linenumber % 2 = 0 THEN upper(regiao_saude) ELSE regiao_saude END"
        course = f"FROM lines_region WHERE ano = {st.YEAR} AND p_type = '{st.COURSE}' GROUP BY ALL"
        extra["e"] = f"SELECT cod_regsaud AS r, {name} AS name, COUNT(DISTINCT l_partkey) AS total_ies_enfermagem {course}"
        extra["q"] = f"""SELECT cod_regsaud AS r, {name} AS name, CAST(SUM(l_quantity) AS BIGINT) AS matriculas_ies,
                                CAST(SUM(l_linenumber) AS BIGINT) AS ingressos_ies, CAST(SUM(p_size) AS BIGINT) AS vagas_ies,
                                CAST(SUM(l_quantity * 2) AS BIGINT) AS inscritos_ies {course}"""
        extra["g"] = f"""SELECT cod_regsaud AS r, {name} AS name, CAST(SUM(l_quantity) AS BIGINT) AS quant_leitos_sus,
                                CAST(SUM(l_linenumber) AS BIGINT) AS quant_leitos_n_sus
                         FROM lines_region WHERE ano = {st.YEAR} GROUP BY ALL"""
    joins = " ".join(f"LEFT JOIN {name} ON a.code = {name}.r" for name in "bcefghijlnop" + "q" * spelled)
    return _with(
        "rates bonds hierarchy people lines_placed lines_region units access gdp",
        f"""SELECT c.uf_sigla, b.r AS cod_regsaud, h.regiao_saude, ROUND(a.rate, 4) AS rate, pop_censo22, TOTAL_PROF,
                   ROUND(CAST(TOTAL_PROF AS DOUBLE) / pop_censo22 * 1000, 4) AS razao_enfermeiros_1000,
                   internacoes_sensiveis_aps, total_ies_enfermagem, matriculas_ies, ingressos_ies, vagas_ies,
                   inscritos_ies, Leitos_UTI_SUS, Leitos_UTI_NSUS, quant_leitos_sus, quant_leitos_n_sus,
                   {", ".join(f'h."{name}"' for name in fixed.UNIT_TYPES.values())}, percentual_precarizacao,
                   CASE WHEN a.code IN ({_OVERRIDES}) THEN 100.0::DOUBLE ELSE road END AS percentual_rodovias,
                   CASE WHEN a.code IN ({_OVERRIDES}) THEN 0.0::DOUBLE ELSE dist_media_capital_km END
                       AS distancia_media_capital_km,
                   obitos_homicidios, ROUND(CAST(obitos_homicidios AS DOUBLE) / pop_censo22 * 1000, 6) AS obitos_1000_hab,
                   vinc_medio, PIB_1000, ROUND(PIB_1000 * 1000 / pop_censo22, 6) AS PIB_percapita,
                   COALESCE(amazonia, 0)::DOUBLE AS percentual_amazonia_legal_corrigido,
                   COALESCE(semiarido, 0)::DOUBLE AS percentual_semiarido_corrigido
            FROM rates a {joins}""",
        **extra,
    )


_REPORT_PARTS = {
    "enriched points line two_places": f"""
        SELECT 'top' AS part, regiao_saude AS item, UNNEST(['rate', 'rate_percent']) AS measure,
               UNNEST([ROUND(rate, 6), round_even(rate * 100, 0)::DOUBLE]) AS value
        FROM (SELECT *, rank() OVER (ORDER BY rate DESC) AS rk FROM enriched) WHERE rk <= 10
        UNION ALL SELECT 'macro_medians', substr(regiao, 8), 'mediana', ROUND(median(rate), 6) FROM enriched GROUP BY ALL
        UNION ALL SELECT 'macro_order', m, 'ord', CAST(row_number() OVER (ORDER BY md DESC, m) AS DOUBLE)
        FROM (SELECT substr(regiao, 8) AS m, median(rate) AS md FROM enriched GROUP BY ALL)
        UNION ALL SELECT 'state_means', uf, 'media', ROUND(AVG(rate), 6) FROM enriched GROUP BY ALL
        UNION ALL SELECT 'overall', 'all', 'media', ROUND(AVG(rate), 6) FROM enriched
        UNION ALL SELECT 'overall', 'all', 'mediana', ROUND(median(rate), 6) FROM enriched
        UNION ALL SELECT 'density_line', 'all', 'slope', ROUND(b, 6) FROM line
        UNION ALL SELECT 'density_line', 'all', 'intercept', ROUND(a, 6) FROM line
        UNION ALL SELECT 'density_line', 'all', 'n', COUNT(*)::DOUBLE FROM points""",
}


def _cross() -> str:
    states = " UNION ALL ".join(
        f"SELECT 'states' AS part, uf AS item, '{name}' AS measure, ROUND({name}, 6) AS value FROM s"
        for name in [*_OCC, *_DEN]
    )
    pairs = " UNION ALL ".join(
        f"""SELECT 'pairs', '{x}~{y}', 'r', ROUND(corr({x}, {y}), 6) FROM wide
            UNION ALL SELECT 'pairs', '{x}~{y}', 'n', CAST(COUNT({x} + {y}) AS DOUBLE) FROM wide"""
        for x, y in _PAIRS
    )
    return _with(
        "state_table wide",
        f"""{states} UNION ALL {pairs}
            UNION ALL SELECT 'line', 'rate_medicos', 'slope', ROUND(regr_slope(razao_medicos, rate_medicos), 6) FROM s
            UNION ALL SELECT 'line', 'rate_medicos', 'n', CAST(regr_count(razao_medicos, rate_medicos) AS DOUBLE)
            FROM s""",
        s="SELECT * FROM state_table WHERE uf <> 'DF'",
    )


_GDP_SHARES = f"""
    SELECT cod_regsaud, regiao_saude, PIB_1000, CASE WHEN n1 > 0 THEN {_SHARE.replace("n *", "n1 *")} END
           AS percentual_amazonia_legal, CASE WHEN n2 > 0 THEN {_SHARE.replace("n *", "n2 *")} END AS percentual_semiarido
    FROM (SELECT cod_regsaud, regiao_saude, ROUND(SUM(v), 4) AS PIB_1000, COUNT(*) FILTER (rare) AS n1,
                 COUNT(*) FILTER (dry) AS n2, COUNT(*) AS total FROM gdp GROUP BY ALL)"""


def _t(r: str, n: str) -> str:
    return f"{r} * sqrt({n} - 2) / sqrt(1 - {r} * {r})"


ORACLE: dict[str, str] = {
    "share_by_class": _share_by_class(),
    "class_share_with_dictionary": _share_by_class("CASE WHEN bond LIKE '%0300' THEN 2 ELSE 1 END"),
    "share_from_stored_layout": _share_by_class(where=f"period = '{st.YEAR}{st.MONTH:02d}'"),
    "one_class_of_exact_codes": _with(
        "placed",
        f"""SELECT cod_regsaud, regiao_saude, CASE WHEN n > 0 THEN {_SHARE} END AS percentual_precarizacao FROM (
              SELECT cod_regsaud, regiao_saude, COUNT(*) FILTER (class = '{fixed.BOND_PRECARIOUS}') AS n,
                     COUNT(*) AS total FROM placed GROUP BY ALL)""",
    ),
    "class_share_zero_fill": _with(
        "gdp",
        f"""SELECT cod_regsaud, regiao_saude, {_SHARE} AS percentual_amazonia_legal FROM (
              SELECT cod_regsaud, regiao_saude, COUNT(*) FILTER (rare) AS n, COUNT(*) AS total FROM gdp GROUP BY ALL)""",
    ),
    "headcount_distinct": _with("heads", "SELECT * FROM heads"),
    "headcount_by_sketch": _with("heads", "SELECT *, true AS within FROM heads"),
    "people_in_two_regions": _with(
        "placed",
        """SELECT a.cod_regsaud AS first, b.cod_regsaud AS second, COUNT(b.person) FILTER (b.person = c.person) AS n_shared
           FROM (SELECT DISTINCT cod_regsaud FROM placed) a
           JOIN (SELECT DISTINCT cod_regsaud, person FROM placed) b
               ON CAST(b.cod_regsaud AS INTEGER) = CAST(a.cod_regsaud AS INTEGER) + 1
           LEFT JOIN (SELECT DISTINCT cod_regsaud, person FROM placed) c
               ON c.cod_regsaud = a.cod_regsaud AND c.person = b.person
           GROUP BY ALL""",
    ),
    "median_by_sketch": _with(
        "regions",
        """SELECT regiao, COUNT(*) AS n, true AS within FROM lineitem JOIN regions ON l_suppkey = s_suppkey GROUP BY ALL""",
    ),
    "per_1000_density": _with(
        "heads people",
        """SELECT h.cod_regsaud, TOTAL_PROF, populacao,
                  ROUND(CAST(TOTAL_PROF AS DOUBLE) / populacao * 1000, 4) AS razao_1000
           FROM heads h LEFT JOIN people p ON h.cod_regsaud = p.cod_regsaud""",
    ),
    "jobs_per_person": _with("jobs", "SELECT * FROM jobs"),
    "registry_by_period": _with(
        "registry",
        """SELECT period[1:4] AS ano, CAST(length(code) AS INTEGER) AS digitos, COUNT(*) AS n,
                  COUNT(DISTINCT code[1:6]) AS n_municipios
           FROM registry GROUP BY ALL""",
    ),
    "unit_type_dictionary": _with(
        "lines_placed units",
        """SELECT cod_regsaud, regiao_saude, p_type AS TP_UNID, COUNT(*) AS numero_estabelecimentos, descricao
           FROM lines_placed LEFT JOIN units ON p_type = tipo GROUP BY ALL""",
    ),
    "wide_types": _with(
        "lines_placed units",
        f"""SELECT cod_regsaud, regiao_saude, {_MART_TYPES}
            FROM lines_placed LEFT JOIN units ON p_type = tipo GROUP BY ALL""",
    ),
    "bed_sums_in_list": _with(
        "lines_placed",
        f"""SELECT cod_regsaud, CAST(SUM(l_quantity) AS BIGINT) AS Leitos_UTI_SUS,
                   CAST(SUM(l_linenumber) AS BIGINT) AS Leitos_UTI_NSUS
            FROM lines_placed WHERE CAST(60 + l_partkey % 30 AS VARCHAR) IN ({_BEDS}) GROUP BY ALL""",
    ),
    "bed_totals_by_region": _with(
        "lines_region",
        """SELECT CAST(ano AS INTEGER) AS ano, uf_sigla, cod_regsaud, regiao_saude,
                  CAST(SUM(l_quantity) AS BIGINT) AS quant_leitos_sus,
                  CAST(SUM(l_linenumber) AS BIGINT) AS quant_leitos_n_sus
           FROM lines_region GROUP BY ALL""",
    ),
    "training_institutions": _with(
        "lines_region",
        "SELECT cod_regsaud, regiao_saude, COUNT(DISTINCT l_partkey) AS total_ies FROM lines_region GROUP BY ALL",
    ),
    "training_supply": _with(
        "lines_region",
        """SELECT cod_regsaud, regiao_saude, CAST(ano AS INTEGER) AS ano, uf_sigla, p_type AS curso,
                  CAST(SUM(l_quantity) AS BIGINT) AS matriculas_ies, CAST(SUM(l_linenumber) AS BIGINT) AS ingressos_ies,
                  CAST(SUM(p_size) AS BIGINT) AS vagas_ies, CAST(SUM(l_quantity * 2) AS BIGINT) AS inscritos_ies
           FROM lines_region GROUP BY ALL""",
    ),
    "mean_distance_override": _with(
        "access",
        f"""SELECT cod_regsaud, regiao_saude,
                   CASE WHEN cod_regsaud IN ({_OVERRIDES}) THEN 0.0::DOUBLE ELSE dist_media_capital_km END
                       AS dist_media_capital_km,
                   CASE WHEN cod_regsaud IN ({_OVERRIDES}) THEN 100.0::DOUBLE WHEN n > 0 THEN {_SHARE} END
                       AS percentual_rodovias
            FROM access""",
    ),
    "mean_distance": _with("access", "SELECT cod_regsaud, regiao_saude, dist_media_capital_km FROM access"),
    "road_access_shares": _with(
        "distances",
        f"""SELECT cod_regsaud, regiao_saude, road AS acesso_rodovia, n, {_SHARE} AS percentual_rodovias
            FROM (SELECT *, CAST(SUM(n) OVER (PARTITION BY cod_regsaud) AS BIGINT) AS total
                  FROM (SELECT cod_regsaud, regiao_saude, road, COUNT(*) AS n FROM distances GROUP BY ALL))""",
    ),
    "admissions_by_region": _with(
        "lines_placed",
        """SELECT CAST(ano AS INTEGER) AS ANO, uf_sigla, cod_regsaud, regiao_saude,
                  CAST(SUM(l_quantity) AS BIGINT) AS internacoes_sensiveis_aps
           FROM lines_placed GROUP BY ALL""",
    ),
    "homicide_rate": _with(
        "people",
        """SELECT d.*, populacao, ROUND(CAST(obitos_homicidios AS DOUBLE) / populacao * 1000, 6) AS obitos_1000_hab
           FROM (SELECT CAST(year(l_shipdate) AS VARCHAR) AS ano, CAST(10000 + l_suppkey AS VARCHAR) AS cod_regsaud,
                        COUNT(*) AS obitos_homicidios FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) d
           LEFT JOIN people p ON p.cod_regsaud = d.cod_regsaud""",
    ),
    "gdp_by_region": _with(
        "gdp people",
        f"""SELECT g.*, populacao, ROUND(PIB_1000 * 1000 / populacao, 6) AS PIB_percapita
            FROM ({_GDP_SHARES}) g LEFT JOIN people p ON p.cod_regsaud = g.cod_regsaud""",
    ),
    "region_mart": _mart(),
    "mart_unique_regions": _mart(),
    "mart_two_spellings": _mart(spelled=True),
    "code_normalise": """
        WITH raw AS (SELECT CAST(520000 + l_suppkey * 7 % 20000 AS VARCHAR) AS six, l_linenumber AS j FROM lineitem),
             codes AS (SELECT CASE WHEN j % 2 = 0 THEN six || CAST(j AS VARCHAR) ELSE six END AS codigo FROM raw)
        SELECT codigo, CASE WHEN length(codigo) = 7 THEN codigo[1:6] WHEN codigo LIKE '53%' THEN '530010'
                            ELSE codigo END AS cod_ibge, COUNT(*) AS n
        FROM codes GROUP BY ALL""",
    "recode_both_ways": _with(
        "states",
        """SELECT DISTINCT sigla AS uf_sigla, c_mktsegment AS profissionais, nome AS UF, sigla, c_mktsegment AS outro
           FROM customer JOIN states ON k = c_nationkey""",
    ),
    "labels_and_classes": _with(
        "enriched",
        """SELECT code AS cod_regiao_saude, substr(regiao, 8) AS macro,
                  substr(regiao, 8) || ' /  ' || substr(regiao, 8) AS macro_dupla, CAST(numero AS INTEGER) AS regiao_order,
                  CAST(CAST(round_even(rate * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS rotulo,
                  CAST(round_even(rate * 100, 0) AS DOUBLE) AS rate_percent
           FROM enriched""",
    ),
    "rates_through_csv": _with("rates", "SELECT code AS regiao_saude, ROUND(rate, 6) AS rate FROM rates"),
    "plot_table_through_parquet": _with(
        "enriched",
        "SELECT regiao, uf, code AS cod_regiao_saude, ROUND(rate, 6) AS rate FROM enriched",
    ),
    "polygons_from_geojson": """
        SELECT CASE s_suppkey % 4 WHEN 1 THEN ' ' WHEN 2 THEN '0' ELSE '' END
                   || CAST(10000 + s_suppkey AS VARCHAR) || CASE s_suppkey % 4 WHEN 3 THEN '.0' ELSE '' END AS reg_id,
               CASE WHEN s_acctbal < 1000 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type,
               CAST(CASE WHEN s_acctbal < 1000 THEN 2 ELSE 1 END AS BIGINT) AS n_polygons,
               ROUND(CAST(s_suppkey * 53 % 500 AS DOUBLE) / 10 - 76, 6) AS x,
               ROUND(CAST(s_suppkey * 37 % 400 AS DOUBLE) / 10 - 35, 6) AS y
        FROM supplier""",
    "key_quality": _with(
        "rates hierarchy heads",
        """SELECT 'rates' AS table_name, COUNT(*) AS n_rows, COUNT(DISTINCT code) AS n_keys, 0::BIGINT AS n_repeated,
                  0::BIGINT AS n_null FROM rates
           UNION ALL SELECT 'hierarchy', COUNT(*), COUNT(DISTINCT cod_regsaud), COUNT(DISTINCT cod_regsaud), 0
           FROM hierarchy
           UNION ALL SELECT 'headcount', COUNT(*), COUNT(cod_regsaud), 0, COUNT(*) FILTER (cod_regsaud IS NULL)
           FROM heads""",
    ),
    "malformed_codes": """
        SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (l_linenumber = 1) AS n_missing,
               COUNT(*) FILTER (l_linenumber IN (2, 4)) AS n_malformed FROM lineitem""",
    "load_with_rejects": """
        SELECT 'codigo' AS "column", COUNT(*) AS n_rows, COUNT(*) FILTER (l_linenumber = 1) AS n_missing,
               COUNT(*) FILTER (l_linenumber IN (2, 3)) AS n_malformed FROM lineitem
        UNION ALL SELECT 'valor', COUNT(*), 0, COUNT(*) FILTER (l_returnflag = 'R') FROM lineitem""",
    "malformed_municipalities": _with(
        "hierarchy",
        """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (CAST(cod_municipio AS BIGINT) % 3 = 0) AS n_missing,
                  COUNT(*) FILTER (CAST(cod_municipio AS BIGINT) % 3 = 1) AS n_malformed FROM hierarchy""",
    ),
    "enrich_rates": _with(
        "enriched",
        """SELECT code AS cod_regiao_saude, ROUND(rate, 6) AS rate, regiao, cod_uf, uf,
                  regiao_saude AS nome_regiao_saude FROM enriched""",
    ),
    "region_dimension": _with("regions", "SELECT regiao, cod_uf, uf, cod_regsaud, regiao_saude FROM regions"),
    "rank_first": _with(
        "two_places",
        """SELECT uf, nome_regiao_saude, CAST(percent AS DOUBLE) / 100 AS rate, code AS cod_regiao_saude,
                  row_number() OVER (ORDER BY percent DESC, code) AS Ranking
           FROM two_places""",
    ),
    **{
        name: _with(
            "two_places",
            f"""SELECT regiao, uf, nome_regiao_saude, CAST(percent AS DOUBLE) / 100 AS rate,
                       CAST(percent AS DOUBLE) AS rate_percent
                FROM (SELECT *, rank() OVER (ORDER BY percent {way}) AS rk FROM two_places) WHERE rk <= 10""",
        )
        for name, way in (("top10_ties", "DESC"), ("bottom10_ties", "ASC"))
    },
    "group_mean": _with(
        "enriched", "SELECT cod_uf, uf, regiao, ROUND(AVG(rate), 6) AS mean_rate FROM enriched GROUP BY ALL"
    ),
    "group_mean_strict": _with(
        "gaps", "SELECT uf, CASE WHEN COUNT(*) = COUNT(rate) THEN ROUND(AVG(rate), 6) END AS media FROM gaps GROUP BY ALL"
    ),
    "group_median": _with(
        "gaps", "SELECT substr(regiao, 8) AS macro, ROUND(median(rate), 6) AS mediana FROM gaps GROUP BY ALL"
    ),
    "group_median_strict": _with(
        "gaps",
        f"""SELECT uf, regiao, CASE WHEN COUNT(*) = COUNT(rate) THEN ROUND(median(rate), 6) END AS mediana
            FROM gaps WHERE uf <> '{_DF}' GROUP BY ALL""",
    ),
    "overall_statistics": _with(
        "enriched", "SELECT COUNT(*) AS n, ROUND(AVG(rate), 6) AS media, ROUND(median(rate), 6) AS mediana FROM enriched"
    ),
    "overall_without_state": _with(
        "enriched",
        f"""SELECT COUNT(*) AS n, ROUND(AVG(rate), 6) AS media, ROUND(median(rate), 6) AS mediana
            FROM enriched WHERE uf <> '{_DF}'""",
    ),
    "six_number": _with(
        "gaps",
        """SELECT regiao, ROUND(MIN(rate), 6) AS min, ROUND(quantile_cont(rate, 0.25), 6) AS q1,
                  ROUND(quantile_cont(rate, 0.5), 6) AS median, ROUND(AVG(rate), 6) AS mean,
                  ROUND(quantile_cont(rate, 0.75), 6) AS q3, ROUND(MAX(rate), 6) AS max,
                  COUNT(*) - COUNT(rate) AS n_missing
           FROM gaps GROUP BY ALL""",
    ),
    "box_stats": _box("SELECT regiao, rate AS v FROM enriched", "regiao", "v", "enriched"),
    "box_stats_of_lines": _box(
        """SELECT regiao, l_extendedprice / 100000 AS v FROM lineitem JOIN regions ON l_suppkey = s_suppkey
           WHERE l_extendedprice / 100000 BETWEEN 0.0 AND 0.6""",
        "regiao", "v", "regions",
    ),
    "box_outliers": _with(
        "enriched hinges",
        """SELECT e.regiao, code AS cod_regiao_saude, ROUND(rate, 6) AS rate
           FROM enriched e JOIN hinges h ON e.regiao = h.regiao
           WHERE rate < q1 - 0.75 * (q3 - q1) OR rate > q3 + 0.75 * (q3 - q1)""",
    ),
    "state_box": _box(
        f"SELECT uf, rate AS v, numero FROM enriched WHERE uf <> '{_DF}'", "uf", "v", "enriched",
        order="""JOIN (SELECT uf AS o_uf, row_number() OVER (ORDER BY median(numero) DESC, uf) AS ord
                       FROM b GROUP BY uf) o ON o.o_uf = b.uf""",
    ),
    "category_order": _with(
        "enriched",
        """SELECT uf, ROUND(m, 6) AS mediana, CAST(row_number() OVER (ORDER BY m DESC, uf) AS INTEGER) AS ord
           FROM (SELECT uf, median(rate) AS m FROM enriched GROUP BY ALL)""",
    ),
    "six_numbers_of_prices": """
        SELECT l_returnflag, ROUND(MIN(l_extendedprice), 4) AS min, ROUND(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
               ROUND(quantile_cont(l_extendedprice, 0.5), 4) AS median, ROUND(AVG(l_extendedprice), 4) AS mean,
               ROUND(quantile_cont(l_extendedprice, 0.75), 4) AS q3, ROUND(MAX(l_extendedprice), 4) AS max,
               COUNT(*) - COUNT(l_extendedprice) AS n_missing
        FROM lineitem GROUP BY ALL""",
    "rates_wide_repeated": _with(
        "occupation",
        f"""SELECT a.code AS regiao_saude, ROUND(a.rate, 6) AS {_OCC[0]}, ROUND(b.rate, 6) AS {_OCC[1]}
            FROM (SELECT code, rate FROM occupation WHERE p = '1-URGENT' UNION ALL
                  SELECT code, rate / 2 FROM occupation WHERE p = '1-URGENT' AND CAST(code AS INTEGER) % 5 = 0) a
            LEFT JOIN (SELECT code, rate FROM occupation WHERE p = '{list(st.OCCUPATIONS.values())[1]}'
                         AND CAST(code AS INTEGER) % 7 <> 1 UNION ALL
                       SELECT code, rate / 2 FROM occupation WHERE p = '{list(st.OCCUPATIONS.values())[1]}'
                         AND CAST(code AS INTEGER) % 7 <> 1 AND CAST(code AS INTEGER) % 5 = 0) b ON b.code = a.code""",
    ),
    "rates_through_comma_csv": _with("rates", "SELECT code AS regiao_saude, ROUND(rate, 6) AS rate FROM rates"),
    "ranking_export": _with(
        "enriched",
        """SELECT CAST(Ranking AS BIGINT) AS Ranking, uf, nome_regiao_saude, ROUND(rate, 6) AS rate FROM (
               SELECT row_number() OVER (ORDER BY rate DESC, code) AS Ranking, uf, regiao_saude AS nome_regiao_saude, rate
               FROM enriched)""",
    ),
    "ranking_published": _with(
        "enriched",
        """SELECT row_number() OVER (ORDER BY rate DESC, code) AS Ranking, uf, regiao_saude AS nome_regiao_saude,
                  ROUND(rate, 6) AS rate FROM enriched""",
    ),
    "rates_wide": _with("wide", f"SELECT regiao_saude, {_rounded(_OCC)}, uf, regiao FROM wide"),
    "density_wide": _with("densities", f"SELECT UF, {_rounded(_DEN)} FROM densities"),
    "state_medians_vs_density": _with(
        "state_table", f"SELECT uf, regiao, {_rounded(_OCC)}, {_rounded(_DEN)} FROM state_table"
    ),
    **{
        name: _with(
            "points",
            f"""SELECT cod_uf, sigla AS uf_sigla, ROUND(razao, 6) AS "Razão", uf, regiao, ROUND({m}, 6) AS mean_rate
                FROM points""",
        )
        for name, m in (("density_vs_mean", "m"), ("density_vs_median", "med"))
    },
    "correlation": _with("points", "SELECT ROUND(corr(razao, m), 6) AS r, COUNT(*) AS n FROM points"),
    "corr_test": _with(
        "points",
        f"""SELECT ROUND(r, 6) AS r, n, n - 2 AS df, ROUND({_t("r", "n")}, 6) AS t,
                   ROUND(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS ci_low,
                   ROUND(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS ci_high, ROUND(p, 6) AS p, p_text,
                   'r = ' || CAST(ROUND(r, 3) AS VARCHAR) || ' , ' || p_text AS annotation
            FROM (SELECT *, CASE WHEN p < 0.01 THEN 'p < 0.01' ELSE 'p = ' || CAST(ROUND(p, 3) AS VARCHAR) END AS p_text
                  FROM (SELECT r, n, {_p_value(f"({_t('r', 'n')})", "(n - 2)")} AS p
                        FROM (SELECT corr(razao, m) AS r, COUNT(*) AS n FROM points)))""",
    ),
    "simple_ols": _with(
        "points",
        """SELECT ROUND(regr_slope(razao, m), 6) AS slope, ROUND(regr_intercept(razao, m), 6) AS intercept,
                  ROUND(regr_r2(razao, m), 6) AS r2, COUNT(*) AS n FROM points""",
    ),
    "simple_ols_clipped": _with(
        "points",
        """SELECT ROUND(regr_slope(razao, m), 6) AS slope, ROUND(regr_intercept(razao, m), 6) AS intercept,
                  ROUND(regr_r2(razao, m), 6) AS r2, COUNT(*) AS n
           FROM points WHERE m BETWEEN 0 AND 0.7 AND razao BETWEEN 4 AND 5""",
    ),
    "fitted_line": _with(
        "points line",
        """SELECT sigla AS uf_sigla, ROUND(m, 6) AS mean_rate,
                  ROUND((SELECT a FROM line) + (SELECT b FROM line) * m, 6) AS fitted FROM points""",
    ),
    "multi_ols": _model(),
    "multi_ols_residuals": _model_rows(f"SELECT COUNT(*) AS n, {_FIVE} FROM left_over"),
    "multi_ols_rows": _model_rows(
        "SELECT regiao_saude, ROUND(fitted, 6) AS fitted, ROUND(r, 6) AS residual, ROUND(leverage, 6) AS leverage FROM left_over"
    ),
    "ols_by_region": _pair_terms("two", ("rate_enfermeiros", "rate_dentista"), True),
    "cross_report_model": _pair_terms("states_two", ("razao_enfermeiros", "razao_dentistas"), False),
    "residuals_by_region": _pair_model(
        "two", "two",
        f"""SELECT regiao, COUNT(*) AS n, {_FIVE} FROM (
              SELECT t.regiao, y - b0 - COALESCE(b1, 0) * x1 - COALESCE(b2, 0) * x2 AS r
              FROM two t JOIN b0 ON t.regiao IS NOT DISTINCT FROM b0.regiao) GROUP BY ALL""",
    ),
    "multi_ols_response_repeated": f"SELECT *, 'rate_medicos' AS dropped_terms FROM ({_model()})",
    "corr_matrix": _with(
        "wide",
        _pair_rows(
            """SELECT 'all' AS level, NULL AS "group", '{x}' AS x, '{y}' AS y, ROUND(CASE WHEN NOT isnan(corr({x}, {y})) THEN corr({x}, {y}) END, 6) AS r,
                      COUNT({x} + {y}) AS n FROM wide
               UNION ALL SELECT 'group', regiao, '{x}', '{y}',
                      ROUND(CASE WHEN NOT isnan(corr({x}, {y})) THEN corr({x}, {y}) END, 6), COUNT({x} + {y})
               FROM wide GROUP BY regiao"""
        ),
    ),
    "pair_points": _with(
        "wide",
        _pair_rows(
            """SELECT regiao_saude, regiao, '{x}' AS x, '{y}' AS y, ROUND({x}, 6) AS x_value, ROUND({y}, 6) AS y_value
               FROM wide WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""
        ),
    ),
    "map_layer": _with(
        "enriched",
        """SELECT CASE s.s_suppkey % 4 WHEN 1 THEN ' ' WHEN 2 THEN '0' ELSE '' END
                      || CAST(10000 + s.s_suppkey AS VARCHAR) || CASE s.s_suppkey % 4 WHEN 3 THEN '.0' ELSE '' END AS reg_id,
                  CASE WHEN s.s_acctbal < 1000 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type,
                  CAST(CASE WHEN s.s_acctbal < 1000 THEN 2 ELSE 1 END AS BIGINT) AS n_polygons, uf,
                  ROUND(rate, 6) AS rate, 4326 AS srid, ROUND(rate, 6) AS colour_position,
                  CAST(floor(rate * 4) AS INTEGER) AS colour_class
           FROM supplier s LEFT JOIN enriched e ON e.s_suppkey = s.s_suppkey AND s.s_suppkey % 7 <> 0""",
    ),
    "colour_bucket": """
        SELECT CASE WHEN v BETWEEN 0 AND 1 THEN CAST(least(floor(v * 4), 3) AS INTEGER) END AS colour_class,
               COUNT(*) AS n, ROUND(MIN(CASE WHEN v BETWEEN 0 AND 1 THEN v END), 6) AS lowest,
               ROUND(MAX(CASE WHEN v BETWEEN 0 AND 1 THEN v END), 6) AS highest
        FROM (SELECT o_totalprice / 400000 AS v FROM orders) GROUP BY ALL""",
    "colour_by_data_range": _with(
        "rates",
        """SELECT code AS cod_regiao_saude, ROUND(v, 6) AS colour_position,
                  CAST(least(floor(v / 0.2), 4) AS INTEGER) AS colour_class
           FROM (SELECT code, (rate - MIN(rate) OVER ()) / (MAX(rate) OVER () - MIN(rate) OVER ()) AS v FROM rates)""",
    ),
    "capital_points": _with(
        "hierarchy",
        f"""SELECT cod_municipio, municipio, ROUND(x, 6) AS longitude, ROUND(y, 6) AS latitude,
                   x BETWEEN -75 AND -28 AND y BETWEEN -33 AND 4 AS in_view
            FROM (SELECT *, CAST((s_suppkey * 53 + j * 7) % 500 AS DOUBLE) / 10 - 76 AS x,
                         CAST((s_suppkey * 37 + j * 5) % 400 AS DOUBLE) / 10 - 35 AS y FROM hierarchy)
            WHERE cod_municipiodv IN ({_CAPITALS})""",
    ),
    "occupation_report_long": _with(*next(iter(_REPORT_PARTS.items()))),
    "cross_report_long": _cross(),
}

# parts of reports that equal a single query, and the lines of all panels
ORACLE |= {
    "occupation_report_state_box": ORACLE["state_box"],
    "occupation_report_overall_of_states": ORACLE["overall_without_state"],
    "occupation_report_density_points": ORACLE["density_vs_mean"],
    "occupation_report_test": ORACLE["corr_test"],
    "occupation_report_ranking": ORACLE["ranking_export"],
    "cross_report_pairs": ORACLE["corr_matrix"],
    "cross_report_pair_points": ORACLE["pair_points"],
    "cross_report_densities": ORACLE["density_wide"],
    "cross_report_lines": _with(
        "state_table",
        " UNION ALL ".join(
            f"""SELECT 'line_{x}' AS part, ROUND(regr_slope({y}, {x}), 6) AS slope, ROUND(regr_intercept({y}, {x}), 6) AS intercept,
                       ROUND(regr_r2({y}, {x}), 6) AS r2, regr_count({y}, {x}) AS n FROM s"""
            for x, y in zip(_OCC, _DEN)
        ),
        s=f"SELECT * FROM state_table WHERE uf <> '{fixed.FEDERAL_DISTRICT_CODE}'",
    ),
}
