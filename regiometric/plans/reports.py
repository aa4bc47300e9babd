"""Reports as dictionaries of plot-ready tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometric import fixed
from regiometric.functions import strip_lead
from regiometric.operators import describe, geo, ranking, relate
from regiometric.operators.territory import enrich_rates, region_dimension

RATE = "rate"


def occupation_report(
    rates: DataFrame,
    hierarchy: DataFrame,
    density: DataFrame | None = None,
    polygons: DataFrame | None = None,
    density_value: str = "Razão",
    n: int = 10,
    clip: tuple[float, float] | None = None,
    test: bool = True,
    stat: str = "mean",
    excluded_state: str | None = fixed.FEDERAL_DISTRICT,
) -> dict[str, DataFrame]:
    """Everything one occupation's charts and tables show.

    Statistics by state leave ``excluded_state`` out (a state with a single region; ``None`` keeps all). Box statistics
    use rows inside ``clip`` only. ``stat`` is the rate's statistic in the density chart, mean or median. Parts that need ``density`` or ``polygons`` are present when those are given; ``test=False`` leaves
    out the correlation test and the ranking, the two parts that run jobs while the report is put together. Most parts
    read ``enriched``: cache it when it is costly to compute and many parts are wanted.
    """
    enriched = enrich_rates(rates, hierarchy)
    named = enriched.withColumn("macro", strip_lead("regiao"))
    district = None if excluded_state is None else F.col("uf") == excluded_state
    listed = enriched.select(
        "regiao", "uf", "nome_regiao_saude", RATE, F.bround(F.col(RATE) * 100, 0).alias("rate_percent")
    )
    report = {
        "enriched": enriched,
        "top": ranking.top_n(listed, RATE, n),
        "bottom": ranking.bottom_n(listed, RATE, n),
        "macro_medians": describe.group_medians(named, ["macro"], RATE, label="rotulo"),
        "macro_order": describe.category_order(named, "macro", RATE),
        "macro_box": describe.box_stats(named, ["macro"], RATE, clip),
        "macro_summary": describe.six_numbers(enriched, ["regiao"], RATE),
        "state_means": describe.group_means(enriched, ["uf"], RATE),
        "overall": describe.overall(enriched, RATE),
        "overall_of_states": describe.overall(enriched, RATE, district),
        "state_medians": describe.group_medians(
            _without(enriched, district), ["uf", "regiao"], RATE, strict=True, label="rotulo"
        ),
        "state_box": describe.state_box(enriched, "uf", "regiao", RATE, fixed.MACRO_REGION_ORDER, district, clip),
        "capitals": geo.capital_points(hierarchy),
    }
    if density is not None:
        points = _without(relate.density_points(density, enriched, stat=stat), district)
        report["density_points"] = points
        report["density_line"] = relate.simple_line(points, "mean_rate", density_value)
        if test:
            report["density_test"] = relate.correlation_test(points, "mean_rate", density_value)
    if test:
        numbered = ranking.order_number(
            enriched.select("uf", "nome_regiao_saude", RATE, "cod_regiao_saude"), RATE, ["cod_regiao_saude"]
        )
        report["ranking"] = numbered.select("Ranking", "uf", "nome_regiao_saude", RATE)
    if polygons is not None:
        report["map"] = geo.map_layer(polygons, enriched)
    return report


def _without(df: DataFrame, excluded: Column | None) -> DataFrame:
    return df if excluded is None else df.filter(~excluded)


def cross_report(
    rates: Mapping[str, DataFrame],
    hierarchy: DataFrame,
    council: DataFrame,
    census: DataFrame,
    densities: Mapping[str, str],
    state: str = "uf",
    panels: Mapping[str, str] | None = None,
    models: Mapping[str, tuple[str, Sequence[str]]] | None = None,
    exclude_state: str | None = None,
) -> dict[str, DataFrame]:
    """Comparison of several occupations.

    ``rates`` maps column names to rate tables; ``densities`` maps profession names of the council table to column
    names. ``panels`` says which rate is drawn against which density; by default the first with the first, and so on.
    ``models`` maps a name to (response, features) over the state table; each runs jobs. ``exclude_state`` is a
    state code left out of the state table.
    """
    names = list(rates)
    dimension = region_dimension(hierarchy, ["cod_regsaud", state, "regiao"])
    wide = relate.rates_wide(rates)
    wide = wide.join(dimension, F.col("regiao_saude") == F.col("cod_regsaud"), "left").drop("cod_regsaud")
    per_state = relate.density_wide(relate.density_long(council, census), densities)
    medians = relate.state_medians(wide, [state, "regiao"], {name: name for name in names})
    table = relate.medians_with_density(medians, per_state, state)
    if exclude_state is not None:
        table = table.filter(F.col(state) != exclude_state)
    report = {
        "rates": wide,
        "pairs": relate.pair_matrix(wide, names, "regiao"),
        "pair_points": relate.pair_points(wide, ["regiao_saude", "regiao"], names),
        "densities": per_state,
        "states": table,
    }
    for name, density in (panels or dict(zip(names, densities.values()))).items():
        report[f"line_{name}"] = relate.simple_line(table, name, density)
    for name, (response, features) in (models or {}).items():
        report[f"model_{name}"] = relate.ols(table, response, features)
    return report
