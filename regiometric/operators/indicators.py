"""Regional indicators built from municipality-level facts.

Sums, counts and means are taken per municipality code before the hierarchy is joined. The big table is read once,
combined inside each task and shuffled as at most one row per code and task, so a municipality that holds a third of all
rows is no heavier than any other, and the join works on the municipality list instead of the facts. Counts per
professional are the exception, see ``jobs_per_professional``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiometric import fixed
from regiometric.functions import classify_prefix, percent_of, ratio
from regiometric.operators.territory import attach_dictionary, attach_region

REGION = ("cod_regsaud", "regiao_saude")


def sums(df: DataFrame, keys: Sequence[str], totals: Mapping[str, str | Column]) -> DataFrame:
    """``{output: input}`` sums per key."""
    return df.groupBy(*keys).agg(*[F.sum(source).alias(out) for out, source in totals.items()])


def sum_by_region(
    facts: DataFrame,
    hierarchy: DataFrame,
    code: str,
    totals: Mapping[str, str],
    region: Sequence[str] = REGION,
    extra_keys: Sequence[str] = (),
    hierarchy_code: str = "cod_municipio",
) -> DataFrame:
    """Sums per region (and ``extra_keys`` of the facts)."""
    per_code = sums(facts, [code, *extra_keys], totals)
    attached = attach_region(per_code, hierarchy, code, region, hierarchy_code)
    return sums(attached, [*extra_keys, *region], {out: out for out in totals})


def count_by_region(
    facts: DataFrame,
    hierarchy: DataFrame,
    code: str,
    region: Sequence[str] = REGION,
    extra_keys: Sequence[str] = (),
    out: str = "n",
    hierarchy_code: str = "cod_municipio",
    prefix: int | None = None,
) -> DataFrame:
    """Row counts per region (and ``extra_keys`` of the facts)."""
    per_code = facts.groupBy(code, *extra_keys).agg(F.count(F.lit(1)).alias(out))
    attached = attach_region(per_code, hierarchy, code, region, hierarchy_code, prefix)
    return sums(attached, [*region, *extra_keys], {out: out})


def mean_by_region(
    facts: DataFrame,
    hierarchy: DataFrame,
    code: str,
    value: str,
    out: str,
    region: Sequence[str] = REGION,
    digits: int = fixed.MART_DIGITS,
    hierarchy_code: str = "cod_municipio",
) -> DataFrame:
    """Mean of the non-missing values per region, rounded half away from zero."""
    per_code = facts.groupBy(code).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    attached = attach_region(per_code, hierarchy, code, region, hierarchy_code)
    return attached.groupBy(*region).agg(F.round(ratio(F.sum("_sum"), F.sum("_n")), digits).alias(out))


def share_within(
    counts: DataFrame, group: Sequence[str], count: str = "n", out: str = "percentual", digits: int = fixed.SHARE_DIGITS
) -> DataFrame:
    """Percentage of each row's count in its group's total. NULL keys form a group of their own.

    ``counts`` is already one row per group and class, so a group's window holds as many rows as there are classes.
    """
    total = F.sum(count).over(Window.partitionBy(*group))
    return counts.withColumn(out, percent_of(F.col(count), total, digits))


def one_class_share(
    counts: DataFrame, group: Sequence[str], kept: Column, out: str, count: str = "n", digits: int = fixed.SHARE_DIGITS
) -> DataFrame:
    """Share of the class selected by ``kept`` per group, in one aggregation.

    Equals ``share_within`` followed by a filter on the class, save that groups without the class stay, with NULL.
    """
    part = F.sum(F.when(kept, F.col(count)))
    return counts.groupBy(*group).agg(percent_of(part, F.sum(count), digits).alias(out))


def class_share(
    registry: DataFrame,
    hierarchy: DataFrame,
    code: str = "CODUFMUN",
    bond: str = "VINCULAC",
    rules: Sequence[tuple[str, str]] = fixed.BOND_RULES,
    default: str = fixed.BOND_UNKNOWN,
    region: Sequence[str] = REGION,
    prefix: int | None = 6,
    dictionary: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Jobs per region and bond class with their percentage of the region's jobs.

    ``dictionary`` (table, key column) repeats each job once per dictionary row of its bond code, as a left join to
    a dictionary with repeated keys does; with unique keys it changes nothing and can be left out.
    """
    per_code = registry.groupBy(code, bond).agg(F.count(F.lit(1)).alias("n"))
    if dictionary is not None:
        table, key = dictionary
        copies = table.groupBy(F.col(key).alias("_bond")).agg(F.count(F.lit(1)).alias("_copies"))
        per_code = per_code.join(copies, F.col(bond) == F.col("_bond"), "left").withColumn(
            "n", F.col("n") * F.coalesce("_copies", F.lit(1))
        )
    attached = attach_region(per_code, hierarchy, code, region, prefix=prefix)
    classed = attached.withColumn("categorias_vinculos", classify_prefix(bond, rules, default))
    counts = sums(classed, [*region, "categorias_vinculos"], {"n": "n"})
    return share_within(counts, region)


def wide_counts(
    counts: DataFrame, keys: Sequence[str], category: str, columns: Mapping[str, str], count: str = "n"
) -> DataFrame:
    """One column per listed category with its summed count, 0 where absent; unlisted categories add no column.

    ``columns`` maps category text to column name. Keys whose categories are all unlisted stay, with zeros.
    """
    wide = counts.groupBy(*keys).pivot(category, list(columns)).agg(F.sum(count))
    return wide.select(
        *keys, *[F.coalesce(F.col(f"`{label}`"), F.lit(0)).alias(name) for label, name in columns.items()]
    )


def types_wide(
    establishments: DataFrame,
    hierarchy: DataFrame,
    dictionary: DataFrame,
    columns: Mapping[str, str] = fixed.UNIT_TYPES,
    code: str = "CODUFMUN",
    unit_type: str = "TP_UNID",
    dictionary_key: str = "TIPO DE ESTABELECIMENTO",
    dictionary_label: str = "descricao_tratado",
    region: Sequence[str] = REGION,
) -> DataFrame:
    """Establishments per region, one column per unit type."""
    counts = count_by_region(establishments, hierarchy, code, region, [unit_type])
    described = attach_dictionary(counts, dictionary, unit_type, dictionary_key, dictionary_label, "_description")
    return wide_counts(described, region, "_description", columns)


def pivot_first(
    df: DataFrame, keys: Sequence[str], names_from: str, values_from: str, columns: Mapping[str, str]
) -> DataFrame:
    """Long to wide for tables with one value per key and name; absent cells are NULL, a repeated cell is an error."""

    def cell(name: str, out: str) -> Column:
        here = F.col(names_from) == name
        repeated = F.raise_error(F.lit(f"more than one value for {name} in a row of {', '.join(keys)}"))
        value = F.max(F.when(here, F.col(values_from)))
        return F.when(F.count_if(here) > 1, repeated).otherwise(value).alias(out)

    return df.groupBy(*keys).agg(*[cell(name, out) for name, out in columns.items()])


def jobs_per_professional(
    registry: DataFrame,
    hierarchy: DataFrame,
    code: str = "CODUFMUN",
    person: str = "CPF_PROF",
    region: Sequence[str] = REGION,
    prefix: int | None = None,
) -> DataFrame:
    """One row per region and professional with the number of registry rows. Feeds head counts and job means.

    Here the hierarchy is joined first: a professional seldom has two rows in a municipality, so counting by code
    beforehand would shuffle the registry once more for nothing. The shuffle key holds the professional, so a large
    region is spread, and rows of one professional are combined before it.
    """
    attached = attach_region(registry.select(code, person), hierarchy, code, region, prefix=prefix)
    return attached.groupBy(*region, person).agg(F.count(F.lit(1)).alias("n_jobs"))


def headcount(
    jobs: DataFrame, region_code: str = "cod_regsaud", person: str = "CPF_PROF", out: str = "TOTAL_PROF"
) -> DataFrame:
    """Distinct professionals per region code. Distinct pairs are shuffled by pair, so a large region is spread."""
    # every row stands for at least one job; the test keeps both users of ``jobs`` on one and the same shuffle
    present = F.when(F.col("n_jobs") > 0, F.col(person))
    return jobs.groupBy(region_code).agg(F.count_distinct(present).alias(out))


def mean_jobs(
    jobs: DataFrame, region: Sequence[str] = REGION, out: str = "vinc_medio", digits: int = fixed.MART_DIGITS
) -> DataFrame:
    """Mean number of jobs per professional and region."""
    return jobs.groupBy(*region).agg(F.round(F.avg("n_jobs"), digits).alias(out))


def density(
    counts: DataFrame,
    population: DataFrame,
    key: str,
    population_key: str,
    count: str,
    people: str,
    out: str,
    per: float = 1000.0,
    digits: int | None = fixed.MART_DIGITS,
) -> DataFrame:
    """Count per ``per`` inhabitants; keys without a population get NULL."""
    side = population.select(F.col(population_key).alias("_key"), F.col(people))
    value = ratio(count, people, per)
    return (
        counts.join(side, F.col(key) == F.col("_key"), "left")
        .drop("_key")
        .withColumn(out, value if digits is None else F.round(value, digits))
    )


def training_supply(
    education: DataFrame,
    totals: Mapping[str, str],
    region: Sequence[str] = REGION,
    extra_keys: Sequence[str] = ("ano", "uf_sigla", "curso"),
    institution: str = "chave_ies",
    out: str = "total_ies",
) -> tuple[DataFrame, DataFrame]:
    """(distinct institutions per region, sums of places and students per region and ``extra_keys``)."""
    institutions = education.groupBy(*region).agg(F.count_distinct(institution).alias(out))
    return institutions, sums(education, [*region, *extra_keys], totals)


def access(
    distances: DataFrame,
    hierarchy: DataFrame,
    code: str = "cod_municipio",
    km: str = "km",
    road: str = "acesso_rodovia",
    yes: str = fixed.ROAD_YES,
    region: Sequence[str] = REGION,
    digits: int = fixed.MART_DIGITS,
) -> DataFrame:
    """Mean distance to the capital and share of municipalities with road access, from one pass over the table.

    The share is NULL for regions without any municipality reached by road.
    """
    per_code = distances.groupBy(code, road).agg(
        F.sum(km).alias("_km"), F.count(km).alias("_n_km"), F.count(F.lit(1)).alias("_n")
    )
    side = per_code.withColumnRenamed(code, "_code")
    attached = attach_region(side, hierarchy, "_code", region)
    part = F.sum(F.when(F.col(road) == yes, F.col("_n")))
    return attached.groupBy(*region).agg(
        F.round(ratio(F.sum("_km"), F.sum("_n_km")), digits).alias("dist_media_capital_km"),
        percent_of(part, F.sum("_n"), fixed.SHARE_DIGITS).alias("percentual_rodovias"),
    )


def flag_share(
    df: DataFrame,
    hierarchy: DataFrame,
    code: str,
    flag: str,
    out: str,
    yes: str = fixed.TERRITORY_YES,
    region: Sequence[str] = REGION,
    hierarchy_code: str = "cod_municipio",
    fill: float | None = 0.0,
) -> DataFrame:
    """Share of a region's municipalities that carry a flag; ``fill`` stands in for regions without one."""
    counts = count_by_region(df, hierarchy, code, region, [flag], hierarchy_code=hierarchy_code)
    shares = one_class_share(counts, region, F.col(flag) == yes, out)
    return shares if fill is None else fill_missing(shares, {out: fill})


def gross_product(
    gdp: DataFrame,
    hierarchy: DataFrame,
    code: str,
    value: str,
    flags: Mapping[str, str],
    out: str,
    yes: str = fixed.TERRITORY_YES,
    region: Sequence[str] = REGION,
    hierarchy_code: str = "cod_municipiodv",
    digits: int = fixed.MART_DIGITS,
) -> DataFrame:
    """Summed product and the share of each territory flag (``{flag column: output}``), from one pass over the table."""
    per_code = gdp.groupBy(code, *flags).agg(F.sum(value).alias("_value"), F.count(F.lit(1)).alias("_n"))
    attached = attach_region(per_code, hierarchy, code, region, hierarchy_code)
    shares = [
        percent_of(F.sum(F.when(F.col(flag) == yes, F.col("_n"))), F.sum("_n"), fixed.SHARE_DIGITS).alias(name)
        for flag, name in flags.items()
    ]
    return attached.groupBy(*region).agg(F.round(F.sum("_value"), digits).alias(out), *shares)


def fill_missing(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """NULL replaced by the value given for the column."""
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in values.items()})


def with_overrides(df: DataFrame, key: str, keys: Sequence[str], values: Mapping[str, float]) -> DataFrame:
    """Fixed values for listed keys; other rows keep theirs."""
    listed = F.col(key).isin(*keys)
    return df.withColumns({name: F.when(listed, F.lit(value)).otherwise(F.col(name)) for name, value in values.items()})
