"""Attaching facts to the territorial hierarchy.

No join here carries a broadcast hint: Spark broadcasts the hierarchy while it is below
``spark.sql.autoBroadcastJoinThreshold`` (statically or after adaptive execution has measured it) and otherwise
shuffles both sides, splitting skewed municipality codes of the fact side. Callers that sum or count should aggregate by
municipality code first (see ``indicators``), which leaves at most one row per code and task to join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiometric.functions import code_of


def region_dimension(hierarchy: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations of ``columns``, e.g. one row per health region from one row per municipality."""
    return hierarchy.select(*columns).distinct()


def attach_region(
    facts: DataFrame,
    hierarchy: DataFrame,
    code: str,
    keep: Sequence[str] = ("cod_regsaud", "regiao_saude"),
    hierarchy_code: str = "cod_municipio",
    prefix: int | None = None,
) -> DataFrame:
    """Left join of facts to the hierarchy by municipality code; unknown codes get NULL territory columns.

    ``prefix=None`` compares whole codes, ``prefix=6`` the first six characters of the fact's code, which also catches
    codes that carry a check digit. Codes stored as numbers are compared as text.
    """
    side = hierarchy.select(code_of(hierarchy, hierarchy_code).alias("_municipality"), *keep)
    fact_code = code_of(facts, code) if prefix is None else F.substring(code_of(facts, code), 1, prefix)
    return facts.join(side, fact_code == F.col("_municipality"), "left").drop("_municipality")


def attach_dictionary(facts: DataFrame, dictionary: DataFrame, code: str, key: str, label: str, out: str) -> DataFrame:
    """Left join to a code dictionary; codes absent from it get a NULL label."""
    side = dictionary.select(code_of(dictionary, key).alias("_key"), F.col(label).alias(out))
    return facts.join(side, code_of(facts, code) == F.col("_key"), "left").drop("_key")


def enrich_rates(
    rates: DataFrame,
    hierarchy: DataFrame,
    dimension: Sequence[str] = ("regiao", "cod_uf", "uf", "cod_regsaud", "regiao_saude"),
    rate_key: str = "regiao_saude",
    region_key: str = "cod_regsaud",
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rates with their macro-region, state and region name; regions the hierarchy lacks stay, with NULLs.

    The rate table calls the region *code* what the hierarchy calls the region *name*; the result holds
    ``cod_regiao_saude`` and ``nome_regiao_saude`` (or what ``renames`` says) instead.
    """
    names = {"code": "cod_regiao_saude", "name": "nome_regiao_saude"} | dict(renames or {})
    side = region_dimension(hierarchy, dimension).withColumnsRenamed(
        {region_key: "_region", "regiao_saude": names["name"]}
    )
    side = side.withColumn("_region", code_of(side, "_region"))
    return (
        rates.withColumn(rate_key, code_of(rates, rate_key))
        .withColumnRenamed(rate_key, names["code"])
        .join(side, F.col(names["code"]) == F.col("_region"), "left")
        .drop("_region")
    )
