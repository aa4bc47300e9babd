"""Test tables in the roles of the package's inputs.

A supplier stands for a health region with six municipalities (order line numbers 1 to 6; line number 7 is a
municipality the hierarchy does not know), its nation for a state, the nation's region for a macro-region. Order lines
are registry rows: the customer is the professional, the order month the period. Everything is derived by Spark from
the whole tables.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regiometric import fixed
from regiometric.plans import MartSettings, MartTables
from regiometric.session import cut_lineage

STATE_CODES = list(fixed.STATES)
MACRO_REGIONS = list(fixed.MACRO_REGION_ORDER)
MUNICIPALITIES = 6

# course, unit labels and periods used by the registered queries
COURSE = "ECONOMY"
UNIT_LABELS = {
    "ECONOMY": "Hospital Geral",
    "LARGE": "Policlínica",
    "MEDIUM": "Farmácia",
    "PROMO": "Posto de Saúde",
    "SMALL": "Telessaúde",
}
YEAR, MONTH, GDP_YEAR = 1997, 3, 1996
OVERRIDE_REGIONS = ("10003", "10007")
OCCUPATIONS = {
    "rate_medicos": "1-URGENT",
    "rate_enfermeiros": "2-HIGH",
    "rate_dentista": "3-MEDIUM",
    "rate_tec_aux_enf": "4-NOT SPECIFIED",
    "rate_tec_aux_sb": "5-LOW",
}
DENSITIES = {
    "AUTOMOBILE": "razao_medicos",
    "BUILDING": "razao_enfermeiros",
    "FURNITURE": "razao_dentistas",
    "HOUSEHOLD": "razao_tec_aux_enf",
    "MACHINERY": "razao_tec_aux_sb",
}
# codes with check digit of the first municipality of 27 regions
CAPITALS = [f"{100001 + key * 10}{key % 10}" for key in range(0, 54, 2)]
SETTINGS = MartSettings(
    year=YEAR, month=MONTH, gdp_year=GDP_YEAR, course=COURSE, override_regions=OVERRIDE_REGIONS
)


@lru_cache(maxsize=64)
def _ddl(application: str, path: str) -> StructType:
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; the footer is read for the schema once per application."""
    path = f"{sf}/{name}.parquet"
    return spark.read.schema(_ddl(spark.sparkContext.applicationId, path)).parquet(path)


def dated(spark: SparkSession, sf: str, name: str, date: str, within: tuple[str, str] | None) -> DataFrame:
    """A table, of which only days from ``within[0]`` to before ``within[1]`` are read where a range is given.

    The period columns are derived from the date, so their filters alone would not reach the parquet statistics.
    """
    df = table(spark, sf, name)
    if within is None:
        return df
    first, end = (F.to_timestamp_ntz(F.lit(day), F.lit("yyyy-MM-dd")) for day in within)
    return df.filter((F.col(date) >= first) & (F.col(date) < end))


def region_code(suppkey: str) -> Column:
    return (F.lit(10000) + F.col(suppkey)).cast("string")


def municipality_code(suppkey: str, number: str) -> Column:
    return (F.lit(100000) + F.col(suppkey) * 10 + F.col(number)).cast("string")


def check_digit_code(suppkey: str, number: str) -> Column:
    return F.concat(municipality_code(suppkey, number), (F.col(suppkey) % 10).cast("string"))


def period(date: str) -> Column:
    return F.date_format(date, "yyyyMM")


def _pick(items: list[str], index: str) -> Column:
    return F.try_element_at(F.array(*[F.lit(item) for item in items]), F.col(index) + 1)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per supplier with its territory columns."""
    nation, macro = table(spark, sf, "nation"), table(spark, sf, "region")
    states = nation.join(macro, nation.n_regionkey == macro.r_regionkey).select(
        "n_nationkey",
        _pick(STATE_CODES, "n_nationkey").alias("uf_sigla"),
        _pick(list(fixed.STATES.values()), "n_nationkey").alias("uf"),
        (F.lit(11) + F.col("n_nationkey")).cast("string").alias("cod_uf"),
        F.col("r_regionkey").cast("string").alias("cod_macrorregiao"),
        F.col("r_name").alias("macrorregiao"),
        _pick(MACRO_REGIONS, "r_regionkey").alias("regiao"),
    )
    supplier = table(spark, sf, "supplier")
    return supplier.join(states, supplier.s_nationkey == states.n_nationkey).select(
        "s_suppkey",
        "s_acctbal",
        region_code("s_suppkey").alias("cod_regsaud"),
        F.col("s_name").alias("regiao_saude"),
        *[name for name in states.columns if name != "n_nationkey"],
    )


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    numbered = regions(spark, sf).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(MUNICIPALITIES))))
    return numbered.select(
        municipality_code("s_suppkey", "_k").alias("cod_municipio"),
        check_digit_code("s_suppkey", "_k").alias("cod_municipiodv"),
        F.concat_ws("-", "regiao_saude", "_k").alias("municipio"),
        "cod_regsaud",
        "regiao_saude",
        "cod_macrorregiao",
        "macrorregiao",
        "uf_sigla",
        "uf",
        "cod_uf",
        "regiao",
        ((F.col("s_suppkey") * 37 + F.col("_k") * 5) % 400 / 10 - 35).cast("string").alias("latitude"),
        ((F.col("s_suppkey") * 53 + F.col("_k") * 7) % 500 / 10 - 76).alias("longitude"),
    )


def registry(spark: SparkSession, sf: str, within: tuple[str, str] | None = None) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), dated(spark, sf, "orders", "o_orderdate", within)
    plain = municipality_code("l_suppkey", "l_linenumber")
    number = F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "2").otherwise("3")
    bond = F.concat(F.lit("0"), F.substring("o_orderpriority", 1, 1), F.lit("0"), number, F.lit("00"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        period("o_orderdate").alias("COMPETEN"),
        F.when(F.col("o_orderstatus") == "P", check_digit_code("l_suppkey", "l_linenumber"))
        .otherwise(plain)
        .alias("CODUFMUN"),
        F.col("o_orderstatus").alias("uf"),
        F.col("o_custkey").cast("string").alias("CPF_PROF"),
        F.when(F.col("l_linestatus") == "O", "223505").otherwise("322205").alias("CBO"),
        F.when(F.col("l_tax") == 0, None).when(F.col("l_tax") == 0.08, "100100").otherwise(bond).alias("VINCULAC"),
    )


def nurses(spark: SparkSession, sf: str) -> DataFrame:
    """Registry rows of one occupation, all periods."""
    return registry(spark, sf).filter(F.col("CBO").startswith(fixed.NURSE_PREFIX))


def bond_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """One row per bond code in use, and a second one for codes that end in 0300."""
    used = registry(spark, sf).select(F.col("VINCULAC").alias("CHAVE")).dropna().distinct()
    return used.withColumn(
        "DESCRIÇÃO",
        F.explode(F.when(F.col("CHAVE").endswith("0300"), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))),
    )


def elsewhere(code: Column, test: Column) -> Column:
    """The code, or one that no other table has where ``test`` holds, so that the row finds no partner."""
    return F.when(test, F.concat(F.lit("9"), code)).otherwise(code)


def population(spark: SparkSession, sf: str) -> DataFrame:
    """Inhabitants per region; every seventh region is listed under a code of its own."""
    return table(spark, sf, "supplier").select(
        elsewhere(region_code("s_suppkey"), F.col("s_suppkey") % 7 == 0).alias("cod_regsaud"),
        (F.floor(F.abs("s_acctbal")) + 2000).cast("bigint").alias("populacao"),
    )


def admissions(spark: SparkSession, sf: str, within: tuple[str, str] | None = None) -> DataFrame:
    return dated(spark, sf, "lineitem", "l_shipdate", within).select(
        F.year("l_shipdate").alias("ANO"),
        municipality_code("l_suppkey", "l_linenumber").alias("MUNIC_RES"),
        F.col("l_quantity").cast("bigint").alias("TOTAL"),
    )


def education(spark: SparkSession, sf: str, within: tuple[str, str] | None = None) -> DataFrame:
    lines, part = dated(spark, sf, "lineitem", "l_shipdate", within), table(spark, sf, "part")
    territory = regions(spark, sf).select("s_suppkey", "cod_regsaud", "regiao_saude", "uf_sigla")
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .join(territory, lines.l_suppkey == territory.s_suppkey)
        .select(
            F.year("l_shipdate").alias("ano"),
            F.col("p_type").alias("curso"),
            F.col("l_partkey").cast("string").alias("chave_ies"),
            "cod_regsaud",
            "regiao_saude",
            "uf_sigla",
            F.col("l_quantity").cast("bigint").alias("qt_matricula_total"),
            F.col("l_linenumber").cast("bigint").alias("qt_ingresso_total"),
            F.col("p_size").cast("bigint").alias("qt_vaga_total"),
            (F.col("l_quantity") * 2).cast("bigint").alias("qt_inscrito_total"),
        )
    )


def beds(spark: SparkSession, sf: str, within: tuple[str, str] | None = None) -> DataFrame:
    return dated(spark, sf, "lineitem", "l_shipdate", within).select(
        municipality_code("l_suppkey", "l_linenumber").alias("CODUFMUN"),
        period("l_shipdate").alias("COMPETEN"),
        (F.lit(60) + F.col("l_partkey") % 30).cast("string").alias("CODLEITO"),
        F.col("l_quantity").cast("int").alias("QT_SUS"),
        F.col("l_linenumber").alias("QT_NSUS"),
    )


def bed_totals(spark: SparkSession, sf: str, within: tuple[str, str] | None = None) -> DataFrame:
    lines = dated(spark, sf, "lineitem", "l_shipdate", within)
    territory = regions(spark, sf).select("s_suppkey", "cod_regsaud", "regiao_saude", "uf_sigla")
    return lines.join(territory, lines.l_suppkey == territory.s_suppkey).select(
        F.year("l_shipdate").alias("ano"),
        "uf_sigla",
        "cod_regsaud",
        "regiao_saude",
        F.col("l_quantity").cast("bigint").alias("quantidade_sus"),
        F.col("l_linenumber").cast("bigint").alias("quantidade_nao_sus"),
    )


def establishments(spark: SparkSession, sf: str, within: tuple[str, str] | None = None) -> DataFrame:
    lines, part = dated(spark, sf, "lineitem", "l_shipdate", within), table(spark, sf, "part")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        municipality_code("l_suppkey", "l_linenumber").alias("CODUFMUN"),
        period("l_shipdate").alias("COMPETEN"),
        F.col("p_type").alias("TP_UNID"),
    )


def unit_types(spark: SparkSession, sf: str) -> DataFrame:
    """Part types with a label; STANDARD is missing from the dictionary."""
    label = None
    for code, text in UNIT_LABELS.items():
        test = F.col("p_type") == code
        label = F.when(test, text) if label is None else label.when(test, text)
    return (
        table(spark, sf, "part")
        .select(F.col("p_type").alias("TIPO DE ESTABELECIMENTO"), label.alias("descricao_tratado"))
        .distinct()
        .filter(F.col("descricao_tratado").isNotNull())
    )


def distances(spark: SparkSession, sf: str) -> DataFrame:
    numbered = table(spark, sf, "supplier").withColumn(
        "_k", F.explode(F.sequence(F.lit(1), F.lit(MUNICIPALITIES)))
    )
    road = F.col("s_acctbal") > F.col("_k") * 1500
    return numbered.select(
        municipality_code("s_suppkey", "_k").alias("cod_municipio"),
        (F.abs("s_acctbal") / 4 + F.col("_k")).alias("km"),
        F.when(road, "sim").otherwise("não").alias("acesso_rodovia"),
    )


def deaths(spark: SparkSession, sf: str, within: tuple[str, str] | None = None) -> DataFrame:
    return (
        dated(spark, sf, "lineitem", "l_shipdate", within)
        .filter(F.col("l_returnflag") == "R")
        .select(
            F.year("l_shipdate").cast("string").alias("ano"),
            region_code("l_suppkey").alias("cod_regsaud"),
            F.lit(1).cast("bigint").alias("obitos_ano"),
        )
    )


def gdp(spark: SparkSession, sf: str, within: tuple[str, str] | None = None) -> DataFrame:
    lines, part = dated(spark, sf, "lineitem", "l_shipdate", within), table(spark, sf, "part")
    rare = (F.col("p_size") == 50) & (F.month("l_shipdate") == 1)
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.year("l_shipdate").alias("ano"),
        check_digit_code("l_suppkey", "l_linenumber").alias("codigo_municipio"),
        F.col("l_extendedprice").alias("produto_interno_bruto_precos_correntes_1000"),
        F.when(rare, "Sim").otherwise("Não").alias("amazonia_legal"),
        F.when(F.col("l_quantity") == 50, "Sim").otherwise("Não").alias("semiarido"),
    )


def _kept() -> Column:
    return F.when(F.col("l_returnflag") != "R", 1).otherwise(0)


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rate per region: share of a supplier's lines that were not returned."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(region_code("l_suppkey").alias("regiao_saude"))
        .agg(F.avg(_kept()).alias("rate"))
    )


def rates_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of which the highest are missing."""
    return rates(spark, sf).withColumn("rate", F.when(F.col("rate") <= 0.69, F.col("rate")))


def occupation_rates(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """One rate table per order priority, cut from one aggregate that is written once.

    Tables after the first list every seventh region under a code of its own, another one each.
    """
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    every = cut_lineage(
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(region_code("l_suppkey").alias("regiao_saude"), "o_orderpriority")
        .agg(F.avg(_kept()).alias("rate"))
    )
    tables = {}
    for i, (name, priority) in enumerate(OCCUPATIONS.items()):
        rows = every.filter(F.col("o_orderpriority") == priority).drop("o_orderpriority")
        code = F.col("regiao_saude")
        tables[name] = rows if i == 0 else rows.withColumn("regiao_saude", elsewhere(code, code.cast("int") % 7 == i))
    return tables


def council(spark: SparkSession, sf: str) -> DataFrame:
    """Professionals per state code and profession: customers per nation and market segment."""
    return (
        table(spark, sf, "customer")
        .groupBy(_pick(STATE_CODES, "c_nationkey").alias("uf_sigla"), F.col("c_mktsegment").alias("profissionais"))
        .agg(F.count(F.lit(1)).alias("qntd_profissionais"))
    )


def census(spark: SparkSession, sf: str) -> DataFrame:
    """Inhabitants per state name: summed customer ids and suppliers, so that states differ."""
    return (
        table(spark, sf, "customer")
        .groupBy(_pick(list(fixed.STATES.values()), "c_nationkey").alias("UF"))
        .agg((F.sum(F.col("c_custkey") % 97) + 1000).cast("bigint").alias("populacao"))
    )


def density(spark: SparkSession, sf: str) -> DataFrame:
    """A density per state: mean customer balance in thousands."""
    return (
        table(spark, sf, "customer")
        .groupBy((F.lit(11) + F.col("c_nationkey")).cast("string").alias("cod_uf"))
        .agg(F.max(_pick(STATE_CODES, "c_nationkey")).alias("UF"), F.avg(F.col("c_acctbal") / 1000).alias("Razão"))
    )


def feature_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One GeoJSON feature per supplier as text: a square, or two squares where the balance is low.

    Codes are written with blanks, leading zeros, or as decimals, as different tools do.
    """
    code = region_code("s_suppkey")
    spellings = F.array(code, F.concat(F.lit(" "), code), F.concat(F.lit("0"), code), F.concat(code, F.lit(".0")))
    reg_id = F.element_at(spellings, (F.col("s_suppkey") % 4 + 1).cast("int"))
    x, y = F.col("s_suppkey") * 53 % 500 / 10 - 76, F.col("s_suppkey") * 37 % 400 / 10 - 35

    def ring(shift: float) -> Column:
        corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        return F.array(*[F.array(x + shift + dx, y + dy) for dx, dy in corners])

    def feature(kind: str, coordinates: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(reg_id.alias("reg_id")).alias("properties"),
                F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            )
        )

    two = F.array(F.array(ring(0.0)), F.array(ring(2.0)))
    text = F.when(F.col("s_acctbal") < 1000, feature("MultiPolygon", two)).otherwise(
        feature("Polygon", F.array(ring(0.0)))
    )
    return table(spark, sf, "supplier").select(text.alias("value"))


def mart_tables(spark: SparkSession, sf: str) -> MartTables:
    month = (f"{YEAR}-{MONTH:02d}-01", f"{YEAR}-{MONTH + 1:02d}-01")
    year, gdp_year = (f"{YEAR}-01-01", f"{YEAR + 1}-01-01"), (f"{GDP_YEAR}-01-01", f"{GDP_YEAR + 1}-01-01")
    return MartTables(
        rates=rates(spark, sf),
        population=population(spark, sf),
        hierarchy=hierarchy(spark, sf),
        admissions=admissions(spark, sf, year),
        education=education(spark, sf, year),
        beds=beds(spark, sf, month),
        bed_totals=bed_totals(spark, sf, year),
        establishments=establishments(spark, sf, month),
        unit_types=unit_types(spark, sf),
        professionals=registry(spark, sf, month),
        distances=distances(spark, sf),
        deaths=deaths(spark, sf, year),
        gdp=gdp(spark, sf, gdp_year),
    )
