"""The regional feature mart: one wide row per region of the rate table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometric import fixed
from regiometric.functions import classify_prefix, period_equals, ratio
from regiometric.operators import indicators as ind
from regiometric.operators.keys import unique_or_error

_GDP_VALUE = "produto_interno_bruto_precos_correntes_1000"


@dataclass(frozen=True)
class MartTables:
    """Input tables; ``sources.schemas`` holds their columns. Codes are text."""

    rates: DataFrame
    population: DataFrame
    hierarchy: DataFrame
    admissions: DataFrame
    education: DataFrame
    beds: DataFrame
    bed_totals: DataFrame
    establishments: DataFrame
    unit_types: DataFrame
    professionals: DataFrame
    distances: DataFrame
    deaths: DataFrame
    gdp: DataFrame


@dataclass(frozen=True)
class MartSettings:
    """Periods, codes and labels; the defaults are those of the nurse study of January 2022."""

    year: int = 2022
    month: int = 1
    gdp_year: int = 2021
    occupation_prefix: str = fixed.NURSE_PREFIX
    course: str = fixed.NURSING_COURSE
    bed_codes: Sequence[str] = fixed.INTENSIVE_CARE_BEDS
    bond_rules: Sequence[tuple[str, str]] = fixed.BOND_RULES
    unit_types: Mapping[str, str] = field(default_factory=lambda: fixed.UNIT_TYPES)
    override_regions: Sequence[str] = fixed.ACCESS_OVERRIDE_REGIONS
    #: Fail where a feature has several rows for a region (two spellings of its name), which would multiply the mart's.
    unique_regions: bool = False


def mart_features(tables: MartTables, settings: MartSettings = MartSettings()) -> dict[str, DataFrame]:
    """The mart's building blocks, each keyed by ``cod_regsaud``; repeated keys would multiply rows of the mart."""
    t, s = tables, settings
    hierarchy = t.hierarchy
    month = lambda df: df.filter(period_equals("COMPETEN", s.year, s.month))

    registry = month(t.professionals).filter(F.col("CBO").startswith(s.occupation_prefix))
    jobs = ind.jobs_per_professional(registry, hierarchy)
    bonds = ind.count_by_region(registry, hierarchy, "CODUFMUN", extra_keys=["VINCULAC"], prefix=6)
    precarious = classify_prefix("VINCULAC", s.bond_rules) == fixed.BOND_PRECARIOUS

    courses = t.education.filter((F.col("ano") == s.year) & (F.col("curso") == s.course))
    institutions, places = ind.training_supply(
        courses,
        {
            "matriculas_ies": "qt_matricula_total",
            "ingressos_ies": "qt_ingresso_total",
            "vagas_ies": "qt_vaga_total",
            "inscritos_ies": "qt_inscrito_total",
        },
        out="total_ies_enfermagem",
    )
    return {
        "population": t.population.select("cod_regsaud", F.col("populacao").alias("pop_censo22")),
        "admissions": ind.sum_by_region(
            t.admissions.filter(F.col("ANO") == s.year),
            hierarchy,
            "MUNIC_RES",
            {"internacoes_sensiveis_aps": "TOTAL"},
            ["uf_sigla", *ind.REGION],
        ),
        "institutions": institutions,
        "places": places.drop("uf_sigla"),
        "intensive_care": ind.sum_by_region(
            month(t.beds).filter(F.col("CODLEITO").isin(*s.bed_codes)),
            hierarchy,
            "CODUFMUN",
            {"Leitos_UTI_SUS": "QT_SUS", "Leitos_UTI_NSUS": "QT_NSUS"},
            ["cod_regsaud"],
        ),
        "beds": ind.sums(
            t.bed_totals.filter(F.col("ano") == s.year),
            ["uf_sigla", *ind.REGION],
            {"quant_leitos_sus": "quantidade_sus", "quant_leitos_n_sus": "quantidade_nao_sus"},
        ).drop("uf_sigla"),
        "establishments": ind.types_wide(month(t.establishments), hierarchy, t.unit_types, s.unit_types),
        "headcount": ind.headcount(jobs),
        "bonds": ind.one_class_share(bonds, ind.REGION, precarious, "percentual_precarizacao"),
        "access": ind.access(t.distances, hierarchy),
        "deaths": ind.sums(
            t.deaths.filter(F.col("ano") == str(s.year)), ["cod_regsaud"], {"obitos_homicidios": "obitos_ano"}
        ),
        "mean_jobs": ind.mean_jobs(jobs),
        "gdp": ind.gross_product(
            t.gdp.filter(F.col("ano") == s.gdp_year),
            hierarchy,
            "codigo_municipio",
            _GDP_VALUE,
            {"amazonia_legal": "percentual_amazonia_legal", "semiarido": "percentual_semiarido"},
            "PIB_1000",
        ),
    }


def region_mart(tables: MartTables, settings: MartSettings = MartSettings()) -> DataFrame:
    """Left joins of all features to the rate table's regions.

    Region code, state and region name come from the population, admission and establishment tables and are NULL where
    those lack the region. Every feature is aggregated to regions before it is joined.

    A feature is grouped by region code and name, so a region spelled in two ways has two rows in it and the mart one
    for each combination over features. Features that share a table (distance and road, product and both flags) are
    one feature here and go together by spelling; joined one by one they would give further combinations. Set
    ``unique_regions`` to have such tables refused instead, when the mart is computed.
    """
    s = settings
    mart = tables.rates.select(
        F.col("regiao_saude").alias("_spine"), F.round("rate", fixed.MART_DIGITS).alias("rate")
    )
    for name, feature in mart_features(tables, settings).items():
        # state and name are taken from one feature each
        drops = {"admissions": ["regiao_saude"], "establishments": []}.get(name, list(ind.REGION[1:]))
        if s.unique_regions:
            feature = unique_or_error(feature, "cod_regsaud", name)
        side = feature.drop(*drops).withColumnRenamed("cod_regsaud", f"_region_{name}")
        mart = mart.join(side, F.col("_spine") == F.col(f"_region_{name}"), "left")

    people = F.col("pop_censo22")
    access_values = {
        "percentual_rodovias": fixed.ACCESS_OVERRIDE_ROAD_SHARE,
        "distancia_media_capital_km": fixed.ACCESS_OVERRIDE_DISTANCE,
    }
    mart = mart.withColumnRenamed("dist_media_capital_km", "distancia_media_capital_km")
    mart = ind.with_overrides(mart, "_spine", s.override_regions, access_values)
    mart = ind.fill_missing(mart, {"percentual_amazonia_legal": 0.0, "percentual_semiarido": 0.0})
    return mart.select(
        "uf_sigla",
        F.col("_region_population").alias("cod_regsaud"),
        "regiao_saude",
        "rate",
        "pop_censo22",
        "TOTAL_PROF",
        F.round(ratio("TOTAL_PROF", people, 1000), fixed.MART_DIGITS).alias("razao_enfermeiros_1000"),
        "internacoes_sensiveis_aps",
        "total_ies_enfermagem",
        "matriculas_ies",
        "ingressos_ies",
        "vagas_ies",
        "inscritos_ies",
        "Leitos_UTI_SUS",
        "Leitos_UTI_NSUS",
        "quant_leitos_sus",
        "quant_leitos_n_sus",
        *s.unit_types.values(),
        "percentual_precarizacao",
        "percentual_rodovias",
        "distancia_media_capital_km",
        "obitos_homicidios",
        ratio("obitos_homicidios", people, 1000).alias("obitos_1000_hab"),
        "vinc_medio",
        "PIB_1000",
        ratio(F.col("PIB_1000") * 1000, people).alias("PIB_percapita"),
        F.col("percentual_amazonia_legal").alias("percentual_amazonia_legal_corrigido"),
        F.col("percentual_semiarido").alias("percentual_semiarido_corrigido"),
    )
