"""The registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometric import fixed, sources
from regiometric.functions import (
    category_number,
    classify_prefix,
    municipality_code,
    percent_label,
    period_equals,
    period_year,
    ratio,
    recode,
    strip_all,
    strip_lead,
    text_code,
)
from regiometric.operators import describe, geo, keys, ranking, relate, sketches
from regiometric.operators import indicators as ind
from regiometric.operators.territory import attach_dictionary, enrich_rates, region_dimension
from regiometric.plans import cross_report, occupation_report, region_mart
from regiometric.session import scratch_dir as scratch
from workloads import standins as st

Query = Callable[[SparkSession, str], DataFrame]
RATE = "rate"
REGISTRY: dict[str, Query] = {}


def register(query: Query) -> Query:
    REGISTRY[query.__name__.removeprefix("query_")] = query
    return query


def district() -> Column:
    return F.col("uf") == fixed.FEDERAL_DISTRICT


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Floating-point results to a fixed number of places, so that another engine's summation order does not show."""
    return df.withColumns({name: F.round(name, digits) for name in columns})


def enriched(spark: SparkSession, sf: str, rates: DataFrame | None = None) -> DataFrame:
    return enrich_rates(st.rates(spark, sf) if rates is None else rates, st.hierarchy(spark, sf))


# -- registry and territory indicators ---------------------------------------------------------------------------


@register
def share_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return ind.class_share(st.nurses(spark, sf), st.hierarchy(spark, sf))


@register
def class_share_with_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = (st.bond_dictionary(spark, sf), "CHAVE")
    return ind.class_share(st.nurses(spark, sf), st.hierarchy(spark, sf), dictionary=dictionary)


@register
def share_from_stored_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Class shares of one month from a registry stored by period and code, joined to the hierarchy without a shuffle."""
    run = uuid.uuid4().hex
    registry = sources.write_bucketed(
        st.nurses(spark, sf), f"registry_{run}", scratch(spark, "registry"), "CODUFMUN", 4, ["COMPETEN"]
    )
    places = sources.write_bucketed(
        st.hierarchy(spark, sf), f"hierarchy_{run}", scratch(spark, "hierarchy"), "cod_municipio", 4
    )
    month = registry.filter(period_equals("COMPETEN", st.YEAR, st.MONTH))
    kind = classify_prefix("VINCULAC").alias("categorias_vinculos")
    counts = sources.attach_stored(month, places).groupBy(*ind.REGION, kind).agg(F.count(F.lit(1)).alias("n"))
    return ind.share_within(counts, ind.REGION, out="percentual")


@register
def one_class_of_exact_codes(spark: SparkSession, sf: str) -> DataFrame:
    counts = ind.count_by_region(st.nurses(spark, sf), st.hierarchy(spark, sf), "CODUFMUN", extra_keys=["VINCULAC"])
    kept = classify_prefix("VINCULAC") == fixed.BOND_PRECARIOUS
    return ind.one_class_share(counts, ind.REGION, kept, "percentual_precarizacao")


@register
def class_share_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return ind.flag_share(
        st.gdp(spark, sf),
        st.hierarchy(spark, sf),
        "codigo_municipio",
        "amazonia_legal",
        "percentual_amazonia_legal",
        hierarchy_code="cod_municipiodv",
    )


@register
def headcount_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return ind.headcount(ind.jobs_per_professional(st.nurses(spark, sf), st.hierarchy(spark, sf)))


def _stored_people(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of the professionals per region and month, written and read back."""
    path = scratch(spark, "people")
    sources.write_parquet(sketches.headcount_sketches(st.nurses(spark, sf), st.hierarchy(spark, sf)), path)
    return sources.read_parquet(spark, path)


@register
def headcount_by_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Exact head counts over all months, and whether those from stored monthly sketches are within their error."""
    found = sketches.combined_headcount(_stored_people(spark, sf), out="estimate").withColumnRenamed("cod_regsaud", "_region")
    exact = headcount_distinct(spark, sf)
    joined = exact.join(found, F.col("cod_regsaud").eqNullSafe(F.col("_region")), "left")
    off = F.abs(F.col("estimate") - F.col("TOTAL_PROF"))
    return joined.select("cod_regsaud", "TOTAL_PROF", (off <= 4 * F.col("relative_error") * F.col("TOTAL_PROF")).alias("within"))


@register
def people_in_two_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Professionals seen in a region and in the next one, from sketches; few enough to be exact here."""
    key = F.col("s_suppkey")
    pairs = st.table(spark, sf, "supplier").select(
        st.region_code("s_suppkey").alias("first"), (F.lit(10001) + key).cast("string").alias("second")
    )
    return sketches.shared_people(_stored_people(spark, sf), pairs)


@register
def median_by_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Median prices of macro-regions out of sketches of states: whether their true ranks are within the error."""
    lines = st.table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    where = st.regions(spark, sf).select("s_suppkey", "regiao", "uf")
    rows = lines.join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    states = sketches.quantile_sketches(rows, ["regiao", "uf"], "l_extendedprice")
    found = sketches.merged_quantiles(states, ["regiao"], {"median": 0.5}).select(F.col("regiao").alias("_regiao"), "median")
    placed = rows.join(found, F.col("regiao") == F.col("_regiao"))
    rank = F.count_if(F.col("l_extendedprice") <= F.col("median")) / F.count(F.lit(1))
    off = F.abs(rank - 0.5)
    return placed.groupBy("regiao").agg(F.count(F.lit(1)).alias("n"), (off <= 2 * sketches.rank_error()).alias("within"))


@register
def per_1000_density(spark: SparkSession, sf: str) -> DataFrame:
    heads = headcount_distinct(spark, sf)
    return ind.density(
        heads, st.population(spark, sf), "cod_regsaud", "cod_regsaud", "TOTAL_PROF", "populacao", "razao_1000"
    )


@register
def jobs_per_person(spark: SparkSession, sf: str) -> DataFrame:
    return ind.mean_jobs(ind.jobs_per_professional(st.nurses(spark, sf), st.hierarchy(spark, sf)))


@register
def registry_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs per year, code length and normalised municipality's state prefix."""
    rows = st.registry(spark, sf).select(
        period_year("COMPETEN").alias("ano"), F.length("CODUFMUN").alias("digitos"), "CODUFMUN"
    )
    return rows.groupBy("ano", "digitos").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(municipality_code("CODUFMUN")).alias("n_municipios")
    )


@register
def unit_type_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    counts = ind.count_by_region(
        st.establishments(spark, sf), st.hierarchy(spark, sf), "CODUFMUN", extra_keys=["TP_UNID"],
        out="numero_estabelecimentos",
    )
    return attach_dictionary(
        counts, st.unit_types(spark, sf), "TP_UNID", "TIPO DE ESTABELECIMENTO", "descricao_tratado", "descricao"
    )


@register
def wide_types(spark: SparkSession, sf: str) -> DataFrame:
    return ind.types_wide(st.establishments(spark, sf), st.hierarchy(spark, sf), st.unit_types(spark, sf))


@register
def bed_sums_in_list(spark: SparkSession, sf: str) -> DataFrame:
    chosen = st.beds(spark, sf).filter(F.col("CODLEITO").isin(*fixed.INTENSIVE_CARE_BEDS))
    totals = {"Leitos_UTI_SUS": "QT_SUS", "Leitos_UTI_NSUS": "QT_NSUS"}
    return ind.sum_by_region(chosen, st.hierarchy(spark, sf), "CODUFMUN", totals, ["cod_regsaud"])


@register
def bed_totals_by_region(spark: SparkSession, sf: str) -> DataFrame:
    totals = {"quant_leitos_sus": "quantidade_sus", "quant_leitos_n_sus": "quantidade_nao_sus"}
    return ind.sums(st.bed_totals(spark, sf), ["ano", "uf_sigla", *ind.REGION], totals)


@register
def training_institutions(spark: SparkSession, sf: str) -> DataFrame:
    return ind.training_supply(st.education(spark, sf), {"matriculas_ies": "qt_matricula_total"})[0]


@register
def query_training_supply(spark: SparkSession, sf: str) -> DataFrame:
    totals = {
        "matriculas_ies": "qt_matricula_total",
        "ingressos_ies": "qt_ingresso_total",
        "vagas_ies": "qt_vaga_total",
        "inscritos_ies": "qt_inscrito_total",
    }
    return ind.training_supply(st.education(spark, sf), totals)[1]


@register
def mean_distance_override(spark: SparkSession, sf: str) -> DataFrame:
    table = ind.access(st.distances(spark, sf), st.hierarchy(spark, sf))
    values = {
        "percentual_rodovias": fixed.ACCESS_OVERRIDE_ROAD_SHARE,
        "dist_media_capital_km": fixed.ACCESS_OVERRIDE_DISTANCE,
    }
    return ind.with_overrides(table, "cod_regsaud", st.OVERRIDE_REGIONS, values)


@register
def mean_distance(spark: SparkSession, sf: str) -> DataFrame:
    return ind.mean_by_region(
        st.distances(spark, sf).withColumnRenamed("cod_municipio", "codigo"), st.hierarchy(spark, sf), "codigo", "km",
        "dist_media_capital_km",
    )


@register
def road_access_shares(spark: SparkSession, sf: str) -> DataFrame:
    facts = st.distances(spark, sf).withColumnRenamed("cod_municipio", "codigo")
    counts = ind.count_by_region(facts, st.hierarchy(spark, sf), "codigo", extra_keys=["acesso_rodovia"])
    return ind.share_within(counts, ind.REGION, out="percentual_rodovias")


@register
def admissions_by_region(spark: SparkSession, sf: str) -> DataFrame:
    return ind.sum_by_region(
        st.admissions(spark, sf), st.hierarchy(spark, sf), "MUNIC_RES", {"internacoes_sensiveis_aps": "TOTAL"},
        ["uf_sigla", *ind.REGION], ["ANO"],
    )


@register
def homicide_rate(spark: SparkSession, sf: str) -> DataFrame:
    totals = ind.sums(st.deaths(spark, sf), ["ano", "cod_regsaud"], {"obitos_homicidios": "obitos_ano"})
    table = ind.density(
        totals, st.population(spark, sf), "cod_regsaud", "cod_regsaud", "obitos_homicidios", "populacao",
        "obitos_1000_hab", digits=None,
    )
    return rounded(table, ["obitos_1000_hab"])


@register
def gdp_by_region(spark: SparkSession, sf: str) -> DataFrame:
    product = ind.gross_product(
        st.gdp(spark, sf), st.hierarchy(spark, sf), "codigo_municipio", "produto_interno_bruto_precos_correntes_1000",
        {"amazonia_legal": "percentual_amazonia_legal", "semiarido": "percentual_semiarido"}, "PIB_1000",
    )
    people = st.population(spark, sf).withColumnRenamed("cod_regsaud", "_region")
    table = product.join(people, F.col("cod_regsaud") == F.col("_region"), "left").drop("_region")
    return rounded(table.withColumn("PIB_percapita", ratio(F.col("PIB_1000") * 1000, "populacao")), ["PIB_percapita"])


@register
def query_region_mart(spark: SparkSession, sf: str) -> DataFrame:
    mart = region_mart(st.mart_tables(spark, sf), st.SETTINGS)
    return rounded(mart, ["obitos_1000_hab", "PIB_percapita"])


@register
def mart_two_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """The mart where two tables spell the names of every fifth region in two ways, so that rows multiply."""
    tables = st.mart_tables(spark, sf)

    def spelled(df: DataFrame, number: str) -> DataFrame:
        other = (F.col("cod_regsaud").cast("int") % 5 == 0) & (F.col(number) % 2 == 0)
        name = F.col("regiao_saude")
        return df.withColumn("regiao_saude", F.when(other, F.upper(name)).otherwise(name))

    tables = replace(
        tables, bed_totals=spelled(tables.bed_totals, "quantidade_nao_sus"),
        education=spelled(tables.education, "qt_ingresso_total"),
    )
    return rounded(region_mart(tables, st.SETTINGS), ["obitos_1000_hab", "PIB_percapita"])


@register
def mart_unique_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The mart with the assertion that no feature repeats a region."""
    mart = region_mart(st.mart_tables(spark, sf), replace(st.SETTINGS, unique_regions=True))
    return rounded(mart, ["obitos_1000_hab", "PIB_percapita"])


# -- codes, labels, sources --------------------------------------------------------------------------------------


@register
def code_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of six and seven digits, with and without the district's prefix, normalised and counted."""
    key, number = F.col("l_suppkey"), F.col("l_linenumber")
    six = (F.lit(520000) + key * 7 % 20000).cast("string")
    raw = F.when(number % 2 == 0, F.concat(six, number.cast("string"))).otherwise(six)
    rows = st.table(spark, sf, "lineitem").select(text_code(raw).alias("codigo"))
    return rows.groupBy("codigo", municipality_code("codigo").alias("cod_ibge")).agg(F.count(F.lit(1)).alias("n"))


@register
def recode_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    """State codes to names and back; segments, which are no states, stay."""
    return st.council(spark, sf).select(
        "uf_sigla",
        "profissionais",
        recode("uf_sigla", fixed.STATES).alias("UF"),
        recode(recode("uf_sigla", fixed.STATES), fixed.STATE_CODES).alias("sigla"),
        recode("profissionais", fixed.STATES).alias("outro"),
    )


@register
def labels_and_classes(spark: SparkSession, sf: str) -> DataFrame:
    return enriched(spark, sf).select(
        "cod_regiao_saude",
        strip_lead("regiao").alias("macro"),
        strip_all(F.concat("regiao", F.lit(" / "), "regiao")).alias("macro_dupla"),
        category_number("regiao").alias("regiao_order"),
        percent_label(RATE).alias("rotulo"),
        F.bround(F.col(RATE) * 100, 0).alias("rate_percent"),
    )


@register
def rates_through_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Rates written as a ``;`` file with an index column, then read back with the schema of such files."""
    path = scratch(spark, "rates-csv")
    sources.write_csv(st.rates(spark, sf).select(F.lit(0).alias(""), "regiao_saude", RATE), path)
    return rounded(sources.read_rates_csv(spark, path), [RATE])


@register
def rates_through_comma_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Rates written and read back as a comma-separated table."""
    path = scratch(spark, "rates-comma")
    sources.write_csv(st.rates(spark, sf).select("regiao_saude", RATE), path, sep=",")
    return rounded(sources.read_csv(spark, path, "regiao_saude string, rate double"), [RATE])


@register
def ranking_export(spark: SparkSession, sf: str) -> DataFrame:
    """The full ranking exported with a report and read back from its CSV file."""
    path = scratch(spark, "report")
    columns = enriched(spark, sf).select("uf", "nome_regiao_saude", RATE, "cod_regiao_saude")
    ranked = ranking.order_number(columns, RATE, ["cod_regiao_saude"]).drop("cod_regiao_saude")
    sources.write_report({"ranking": ranked}, path)
    schema = "Ranking bigint, uf string, nome_regiao_saude string, rate double"
    return rounded(sources.read_csv(spark, f"{path}/ranking_csv", schema, sep=";"), [RATE])


@register
def ranking_published(spark: SparkSession, sf: str) -> DataFrame:
    """The full ranking from a report that was published twice and, the second time, written over the first."""
    path = scratch(spark, "published")
    columns = enriched(spark, sf).select("uf", "nome_regiao_saude", RATE, "cod_regiao_saude")
    ranked = ranking.order_number(columns, RATE, ["cod_regiao_saude"]).drop("cod_regiao_saude")
    sources.publish_report({"ranking": ranked.withColumn(RATE, F.lit(0.0))}, path)
    sources.publish_report({"ranking": ranked}, path)
    return rounded(sources.read_published(spark, path, "ranking"), [RATE])


@register
def plot_table_through_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "plot-table")
    sources.write_parquet(enriched(spark, sf), path, partition_by=["regiao"])
    columns = ["regiao", "uf", "cod_regiao_saude", RATE]
    return rounded(sources.read_parquet(spark, path, columns), [RATE])


@register
def polygons_from_geojson(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "polygons")
    st.feature_lines(spark, sf).write.text(path)
    polygons = sources.read_geojson(spark, path)
    corner = F.col("polygons")[0][0][0]
    return polygons.select(
        "reg_id",
        "geometry_type",
        F.size("polygons").cast("bigint").alias("n_polygons"),
        F.round(corner[0], 6).alias("x"),
        F.round(corner[1], 6).alias("y"),
    )


@register
def key_quality(spark: SparkSession, sf: str) -> DataFrame:
    tables = {
        "rates": st.rates(spark, sf).withColumnRenamed("regiao_saude", "cod_regsaud"),
        "hierarchy": st.hierarchy(spark, sf),
        "headcount": headcount_distinct(spark, sf),
    }
    return keys.key_report(tables, "cod_regsaud")


@register
def malformed_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all lines: missing, text, whole-valued decimals, fractions and whole numbers by line number."""
    part, code = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    written = (
        F.when(part == 2, F.concat(F.lit("x"), code))
        .when(part == 3, F.concat(code, F.lit(".0")))
        .when(part == 4, F.concat(code, F.lit(".5")))
        .when(part > 4, code)
    )
    return sources.rejected_codes(st.table(spark, sf, "lineitem").select(written.alias("c")), "c")


@register
def load_with_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """A file of codes and quantities loaded once: per column, how many are missing and how many malformed."""
    part, code = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    written = F.when(part == 2, F.concat(F.lit("x"), code)).when(part == 3, F.concat(code, F.lit(".5"))).when(part > 3, code)
    amount = F.when(F.col("l_returnflag") == "R", F.lit("n/d")).otherwise(F.col("l_quantity").cast("string"))
    path, target = scratch(spark, "codes-csv"), scratch(spark, "codes")
    sources.write_csv(st.table(spark, sf, "lineitem").select(written.alias("codigo"), amount.alias("valor")), path)
    return sources.load_csv(spark, path, "codigo bigint, valor double", target, sep=";")


@register
def malformed_municipalities(spark: SparkSession, sf: str) -> DataFrame:
    """Municipality codes, of which a third is missing and a third replaced by names."""
    third = F.col("cod_municipio").cast("bigint") % 3
    code = F.when(third == 1, F.col("municipio")).when(third == 2, F.col("cod_municipio"))
    return sources.rejected_codes(st.hierarchy(spark, sf).select(code.alias("c")), "c")


# -- rates: enrichment, description, ranking ---------------------------------------------------------------------


@register
def query_enrich_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(enriched(spark, sf), [RATE])


@register
def query_region_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return region_dimension(st.hierarchy(spark, sf), ["regiao", "cod_uf", "uf", "cod_regsaud", "regiao_saude"])


@register
def rank_first(spark: SparkSession, sf: str) -> DataFrame:
    """Order numbers by the rate rounded to two places, which has many ties."""
    table = enriched(spark, sf).withColumn(RATE, F.round(RATE, 2))
    columns = table.select("uf", "nome_regiao_saude", RATE, "cod_regiao_saude")
    return ranking.order_number(columns, RATE, ["cod_regiao_saude"])


def _two_places(spark: SparkSession, sf: str) -> DataFrame:
    table = enriched(spark, sf).withColumn(RATE, F.round(RATE, 2))
    return table.select(
        "regiao", "uf", "nome_regiao_saude", RATE, F.bround(F.col(RATE) * 100, 0).alias("rate_percent")
    )


@register
def top10_ties(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_n(_two_places(spark, sf), RATE, 10)


@register
def bottom10_ties(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.bottom_n(_two_places(spark, sf), RATE, 10)


@register
def group_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.group_means(enriched(spark, sf), ["cod_uf", "uf", "regiao"], RATE, "mean_rate"),
                   ["mean_rate"])


@register
def group_mean_strict(spark: SparkSession, sf: str) -> DataFrame:
    gaps = enriched(spark, sf, st.rates_with_gaps(spark, sf))
    return rounded(describe.group_means(gaps, ["uf"], RATE), ["media"])


@register
def group_median(spark: SparkSession, sf: str) -> DataFrame:
    gaps = enriched(spark, sf, st.rates_with_gaps(spark, sf)).withColumn("macro", strip_lead("regiao"))
    return rounded(describe.group_medians(gaps, ["macro"], RATE), ["mediana"])


@register
def group_median_strict(spark: SparkSession, sf: str) -> DataFrame:
    gaps = enriched(spark, sf, st.rates_with_gaps(spark, sf)).filter(~district())
    return rounded(describe.group_medians(gaps, ["uf", "regiao"], RATE, strict=True), ["mediana"])


@register
def overall_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.overall(enriched(spark, sf), RATE), ["media", "mediana"])


@register
def overall_without_state(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.overall(enriched(spark, sf), RATE, district()), ["media", "mediana"])


@register
def six_number(spark: SparkSession, sf: str) -> DataFrame:
    gaps = enriched(spark, sf, st.rates_with_gaps(spark, sf))
    return rounded(describe.six_numbers(gaps, ["regiao"], RATE), ["min", "q1", "median", "mean", "q3", "max"])


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@register
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.box_stats(enriched(spark, sf), ["regiao"], RATE), BOX)


@register
def box_stats_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Box statistics of a measure of every order line within an axis range, per macro-region."""
    lines = st.table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    where = st.regions(spark, sf).select("s_suppkey", "regiao")
    rows = lines.join(where, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "regiao", (F.col("l_extendedprice") / 100000).alias("valor")
    )
    return rounded(describe.box_stats(rows, ["regiao"], "valor", clip=(0.0, 0.6), staged=True), BOX)


@register
def box_outliers(spark: SparkSession, sf: str) -> DataFrame:
    outliers = describe.box_outliers(enriched(spark, sf), ["regiao"], RATE, reach=0.75)
    return rounded(outliers.select("regiao", "cod_regiao_saude", RATE), [RATE])


@register
def state_box(spark: SparkSession, sf: str) -> DataFrame:
    table = describe.state_box(
        enriched(spark, sf), "uf", "regiao", RATE, fixed.MACRO_REGION_ORDER, district(), clip=(0.0, 1.0)
    )
    return rounded(table, BOX)


@register
def category_order(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.category_order(enriched(spark, sf), "uf", RATE), ["mediana"])


# -- relations between measures ----------------------------------------------------------------------------------


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    dimension = region_dimension(st.hierarchy(spark, sf), ["cod_regsaud", "uf", "regiao"])
    wide = relate.rates_wide(st.occupation_rates(spark, sf))
    return wide.join(dimension, F.col("regiao_saude") == F.col("cod_regsaud"), "left").drop("cod_regsaud")


@register
def rates_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_wide(spark, sf), list(st.OCCUPATIONS))


@register
def six_numbers_of_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Six numbers of all line prices, which lie far outside 0 to 1, in three large groups."""
    lines = st.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    stats = describe.six_numbers(lines, ["l_returnflag"], "l_extendedprice")
    return rounded(stats, ["min", "q1", "median", "mean", "q3", "max"], 4)


@register
def rates_wide_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Two rate tables that list every fifth region twice, with two rates."""
    tables = dict(list(st.occupation_rates(spark, sf).items())[:2])
    twice = {
        name: df.unionByName(df.filter(F.col("regiao_saude").cast("int") % 5 == 0).withColumn(RATE, F.col(RATE) / 2))
        for name, df in tables.items()
    }
    return rounded(relate.rates_wide(twice), list(twice))


@register
def density_wide(spark: SparkSession, sf: str) -> DataFrame:
    long = relate.density_long(st.council(spark, sf), st.census(spark, sf))
    return rounded(relate.density_wide(long, st.DENSITIES), list(st.DENSITIES.values()))


def _state_table(spark: SparkSession, sf: str) -> DataFrame:
    long = relate.density_long(st.council(spark, sf), st.census(spark, sf))
    per_state = relate.state_medians(_wide(spark, sf), ["uf", "regiao"], {name: name for name in st.OCCUPATIONS})
    return relate.medians_with_density(per_state, relate.density_wide(long, st.DENSITIES), "uf")


@register
def state_medians_vs_density(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_state_table(spark, sf), [*st.OCCUPATIONS, *st.DENSITIES.values()])


def _points(spark: SparkSession, sf: str, stat: str = "mean") -> DataFrame:
    return relate.density_points(st.density(spark, sf), enriched(spark, sf), stat=stat).filter(~district())


@register
def density_vs_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_points(spark, sf), ["Razão", "mean_rate"])


@register
def density_vs_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_points(spark, sf, "median"), ["Razão", "mean_rate"])


@register
def correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relate.correlation(_points(spark, sf), "mean_rate", "Razão"), ["r"])


@register
def corr_test(spark: SparkSession, sf: str) -> DataFrame:
    table = relate.correlation_test(_points(spark, sf), "mean_rate", "Razão")
    return rounded(table, ["r", "t", "ci_low", "ci_high", "p"])


@register
def simple_ols(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relate.simple_line(_points(spark, sf), "mean_rate", "Razão"), ["slope", "intercept", "r2"])


@register
def simple_ols_clipped(spark: SparkSession, sf: str) -> DataFrame:
    line = relate.simple_line(_points(spark, sf), "mean_rate", "Razão", clip_x=(0.0, 0.7), clip_y=(4.0, 5.0))
    return rounded(line, ["slope", "intercept", "r2"])


@register
def fitted_line(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    fitted = relate.fitted_values(points, "mean_rate", relate.simple_line(points, "mean_rate", "Razão"))
    return rounded(fitted.select("uf_sigla", "mean_rate", "fitted"), ["mean_rate", "fitted"])


MODEL = ("rate_medicos", ["rate_enfermeiros", "rate_dentista", "rate_tec_aux_enf"])
FIGURES = ["estimate", "std_error", "t_value", "p_value", "r2", "r2_adjusted", "residual_error", "f_value", "f_p_value"]


@register
def multi_ols(spark: SparkSession, sf: str) -> DataFrame:
    """One rate on three others, over all regions."""
    return rounded(relate.ols(_wide(spark, sf), *MODEL).drop("dropped_terms"), FIGURES, 5)


@register
def multi_ols_response_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """The response is listed among the features and dropped from them."""
    response, features = MODEL
    table = relate.ols(_wide(spark, sf), response, [features[0], response, *features[1:]])
    return rounded(table.withColumn("dropped_terms", F.concat_ws(",", "dropped_terms")), FIGURES, 5)


@register
def multi_ols_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Five numbers of the residuals of the model of all regions."""
    return rounded(relate.residual_summary(_wide(spark, sf), *MODEL), ["min", "q1", "median", "q3", "max"])


@register
def multi_ols_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every region's fitted value, residual and leverage."""
    rows = relate.ols_rows(_wide(spark, sf), *MODEL)
    return rounded(rows.select("regiao_saude", "fitted", "residual", "leverage"), ["fitted", "residual", "leverage"])


@register
def ols_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """A model of its own for every macro-region."""
    table = relate.ols(_wide(spark, sf), MODEL[0], MODEL[1][:2], ["regiao"]).drop("dropped_terms")
    return rounded(table, FIGURES, 5)


@register
def residuals_by_region(spark: SparkSession, sf: str) -> DataFrame:
    """Five numbers of the residuals of every macro-region's own model."""
    table = relate.residual_summary(_wide(spark, sf), MODEL[0], MODEL[1][:2], ["regiao"])
    five = ["min", "q1", "median", "q3", "max"]
    return table.withColumns({name: F.round(name, 6) + 0.0 for name in five})  # no zero below zero


@register
def cross_report_model(spark: SparkSession, sf: str) -> DataFrame:
    """The model that the cross-occupation report fits over states."""
    report = cross_report(
        st.occupation_rates(spark, sf), st.hierarchy(spark, sf), st.council(spark, sf), st.census(spark, sf),
        st.DENSITIES, models={"densities": ("razao_medicos", ["razao_enfermeiros", "razao_dentistas"])},
        exclude_state=fixed.FEDERAL_DISTRICT_CODE,
    )
    return rounded(report["model_densities"].drop("dropped_terms"), FIGURES, 5)


@register
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(relate.pair_matrix(_wide(spark, sf), list(st.OCCUPATIONS), "regiao"), ["r"])


@register
def pair_points(spark: SparkSession, sf: str) -> DataFrame:
    points = relate.pair_points(_wide(spark, sf), ["regiao_saude", "regiao"], list(st.OCCUPATIONS))
    return rounded(points, ["x_value", "y_value"])


# -- map tables --------------------------------------------------------------------------------------------------


@register
def map_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh region has another code in the rate table; its polygon stays. Polygon files spell codes in four ways."""
    polygons = sources.parse_features(st.feature_lines(spark, sf))
    code = F.col("cod_regiao_saude")
    coded = enriched(spark, sf).withColumn("cod_regiao_saude", st.elsewhere(code, code.cast("int") % 7 == 10000 % 7))
    layer = geo.map_layer(polygons, coded).select(
        "reg_id", "geometry_type", F.size("polygons").cast("bigint").alias("n_polygons"), "uf", RATE, "srid",
        "colour_position", "colour_class",
    )
    return rounded(layer, [RATE, "colour_position"])


@register
def colour_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """Colours of all order prices on a scale that does not cover the dearest."""
    prices = st.table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 400000).alias("valor"))
    coloured = geo.with_colour(prices, "valor")
    return coloured.groupBy("colour_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min("colour_position"), 6).alias("lowest"),
        F.round(F.max("colour_position"), 6).alias("highest"),
    )


@register
def colour_by_data_range(spark: SparkSession, sf: str) -> DataFrame:
    coloured = geo.with_colour(enriched(spark, sf), RATE, limits=None, step=0.2)
    return rounded(coloured.select("cod_regiao_saude", "colour_position", "colour_class"), ["colour_position"])


@register
def capital_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geo.capital_points(st.hierarchy(spark, sf), st.CAPITALS), ["longitude", "latitude"])


# -- reports -----------------------------------------------------------------------------------------------------


@register
def occupation_report_long(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the occupation report stacked: part, item, measure, value."""
    report = occupation_report(st.rates(spark, sf), st.hierarchy(spark, sf), st.density(spark, sf), test=False)
    parts = [
        _tall(report["top"], "top", F.col("nome_regiao_saude"), [RATE, "rate_percent"]),
        _tall(report["macro_medians"], "macro_medians", F.col("macro"), ["mediana"]),
        _tall(report["macro_order"], "macro_order", F.col("macro"), ["ord"]),
        _tall(report["state_means"], "state_means", F.col("uf"), ["media"]),
        _tall(report["overall"], "overall", F.lit("all"), ["media", "mediana"]),
        _tall(report["density_line"], "density_line", F.lit("all"), ["slope", "intercept", "n"]),
    ]
    return _stack(parts)


@register
def cross_report_long(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the cross-occupation report stacked: part, item, measure, value."""
    rates = st.occupation_rates(spark, sf)
    report = cross_report(
        rates, st.hierarchy(spark, sf), st.council(spark, sf), st.census(spark, sf), st.DENSITIES,
        exclude_state=fixed.FEDERAL_DISTRICT_CODE,
    )
    parts = [
        _tall(report["states"], "states", F.col("uf"), [*st.OCCUPATIONS, *st.DENSITIES.values()]),
        _tall(report["pairs"].filter(F.col("level") == "all"), "pairs", F.concat_ws("~", "x", "y"), ["r", "n"]),
        _tall(report["line_rate_medicos"], "line", F.lit("rate_medicos"), ["slope", "n"]),
    ]
    return _stack(parts)


def _occupation_part(part: str, digits: dict[str, int] | None = None, test: bool = False) -> Query:
    """One part of the occupation report, as the report gives it."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        polygons = sources.parse_features(st.feature_lines(spark, sf))
        report = occupation_report(
            st.rates(spark, sf), st.hierarchy(spark, sf), st.density(spark, sf), polygons, clip=(0.0, 1.0), test=test
        )
        return report[part].withColumns({name: F.round(name, n) for name, n in (digits or {}).items()})

    return query


def _cross_part(parts: Sequence[str], measures: Sequence[str], named: bool = False) -> Query:
    """Parts of the cross-occupation report that have the same columns, stacked."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        report = cross_report(
            st.occupation_rates(spark, sf), st.hierarchy(spark, sf), st.council(spark, sf), st.census(spark, sf),
            st.DENSITIES, exclude_state=fixed.FEDERAL_DISTRICT_CODE,
        )
        tables = [report[part].withColumn("part", F.lit(part)) if named else report[part] for part in parts]
        return rounded(reduce(DataFrame.unionByName, tables), measures)

    return query


REGISTRY |= {
    "occupation_report_state_box": _occupation_part("state_box", dict.fromkeys(BOX, 6)),
    "occupation_report_overall_of_states": _occupation_part("overall_of_states", {"media": 6, "mediana": 6}),
    "occupation_report_density_points": _occupation_part("density_points", {"Razão": 6, "mean_rate": 6}),
    "occupation_report_test": _occupation_part(
        "density_test", dict.fromkeys(["r", "t", "ci_low", "ci_high", "p"], 6), test=True
    ),
    "occupation_report_ranking": _occupation_part("ranking", {RATE: 6}, test=True),
    "cross_report_pairs": _cross_part(["pairs"], ["r"]),
    "cross_report_pair_points": _cross_part(["pair_points"], ["x_value", "y_value"]),
    "cross_report_densities": _cross_part(["densities"], list(st.DENSITIES.values())),
    "cross_report_lines": _cross_part(
        [f"line_{name}" for name in st.OCCUPATIONS], ["slope", "intercept", "r2"], named=True
    ),
}


def _tall(df: DataFrame, part: str, item: Column, measures: Sequence[str]) -> DataFrame:
    wide = df.select(
        F.lit(part).alias("part"), item.alias("item"), *[F.col(name).cast("double").alias(name) for name in measures]
    )
    return wide.unpivot(["part", "item"], list(measures), "measure", "value")


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return rounded(result, ["value"])
