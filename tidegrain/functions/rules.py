"""Traffic-light rules as expressions.  GREEN is cheap, RED dear."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The status codes of the data model.
GREEN, YELLOW, RED, UNKNOWN = "VERDE", "AMARELO", "VERMELHO", "INSUFICIENTE"
STATUSES = (GREEN, YELLOW, RED)


def band(price: Column, reference: Column, percent: int, yellow: str = YELLOW) -> Column:
    """Outside reference +- percent; without a reference the price is its own; null without a price."""
    ref = F.coalesce(reference, price)
    return F.when(price.isNull(), F.lit(None)).when(price * 100 < ref * (100 - percent), GREEN).when(price * 100 > ref * (100 + percent), RED).otherwise(yellow)


def mean_band(price: Column, total: Column, n: Column, percent: int = 15, least: int = 6) -> Column:
    """band() around total / n without dividing; too few observations are unknown."""
    return F.when(n < least, UNKNOWN).when(price * n * 100 < total * (100 - percent), GREEN).when(price * n * 100 > total * (100 + percent), RED).otherwise(YELLOW)


def month_over_month(price: Column, previous: Column, percent: int = 10) -> Column:
    """band() around the previous price; unknown without one."""
    return F.when(previous.isNull() | (previous <= 0), UNKNOWN).otherwise(band(price, previous, percent))


def sigma_band(price: Column, reference: Column, sigma: Column) -> Column:
    """Outside reference +- sigma; null if a value is missing or sigma is not positive."""
    bad = price.isNull() | reference.isNull() | sigma.isNull() | (sigma <= 0)
    return F.when(bad, F.lit(None)).when(price < reference - sigma, GREEN).when(price > reference + sigma, RED).otherwise(YELLOW)


def sensitive(price: Column, reference: Column, cv: Column, factor: Column | None = None) -> Column:
    """Band of the series' coefficient of variation, at least 2, 5 or 8 % by price; above 40 % always yellow."""
    factor = F.lit(1) if factor is None else factor
    floor = F.when(reference <= 5, 0.02).when(reference <= 20, 0.05).otherwise(0.08)
    wide = F.greatest(F.coalesce(cv.cast("double"), F.lit(0.0)), floor)
    p, r = price.cast("double") / F.nullif(factor, F.lit(0)), reference.cast("double") / F.nullif(factor, F.lit(0))
    bad = price.isNull() | (price <= 0) | reference.isNull() | (reference <= 0) | factor.isNull() | (factor <= 0)
    return F.when(bad, F.lit(None)).when(wide > 0.40, YELLOW).when(p < r * (1 - wide), GREEN).when(p > r * (1 + wide), RED).otherwise(YELLOW)


def offer(price: Column, mean: Column, sigma: Column, n: Column) -> Column:
    """One standard deviation below, above or within the mean; without spread, by comparison alone."""
    return (
        F.when((n < 2) | mean.isNull() | price.isNull(), UNKNOWN)
        .when(F.coalesce(sigma, F.lit(0.0)) == 0, F.when(price < mean, "OFERTA").when(price > mean, "ALTA").otherwise("EQUILIBRADO"))
        .when((price - mean) / F.nullif(sigma, F.lit(0.0)) <= -1, "OFERTA")
        .when((price - mean) / F.nullif(sigma, F.lit(0.0)) >= 1, "ALTA")
        .otherwise("EQUILIBRADO")
    )


def cold_start(price: Column, reference: Column) -> Column:
    """Below 75 % or above 130 % of the reference."""
    return F.when(price.isNull() | reference.isNull() | (reference <= 0), YELLOW).when(price * 100 < reference * 75, GREEN).when(price * 100 > reference * 130, RED).otherwise(YELLOW)


def agreement(first: Column, second: Column) -> Column:
    """The status two baselines agree on, yellow if they differ, the one there is if one is missing."""
    return F.when(first.isNotNull() & second.isNotNull() & (first != second), YELLOW).otherwise(F.coalesce(second, first))


def agreement_confidence(first: Column, c1: Column, second: Column, c2: Column) -> Column:
    """60/40 of both confidences, at most 100 if they agree and 40 if not; the second's alone, or half the first's."""
    both = F.least(c1 * 0.6 + c2 * 0.4, F.when(first == second, 100.0).otherwise(40.0))
    return F.when(first.isNotNull() & second.isNotNull(), both).when(second.isNotNull(), c2).when(first.isNotNull(), c1 * 0.5)


def coverage_grade(months: Column) -> Column:
    return F.when(months >= 12, "COMPLETO").when(months >= 9, "PARCIAL").when(months >= 6, "CRÍTICO").otherwise("GRAVE")


def gap_severity(months: Column) -> Column:
    return F.when(months <= 2, "GRAVE").when(months <= 6, "MEDIO").otherwise("OK")


def trend(expected: Column, now: Column, n: Column) -> Column:
    """More than 5 % down or up; null with under 24 months."""
    return F.when((n < 24) | expected.isNull() | now.isNull(), F.lit(None)).when(expected * 100 < now * 95, "QUEDA").when(expected * 100 > now * 105, "ALTA").otherwise("ESTAVEL")


def known_status(x: Column) -> Column:
    """A status of the three, else yellow."""
    return F.when(F.upper(F.trim(x)).isin(*STATUSES), F.upper(F.trim(x))).otherwise(YELLOW)


def status_rank(x: Column) -> Column:
    return F.when(x == GREEN, 0).when(x == YELLOW, 1).when(x == RED, 2).otherwise(3)


def quorum(red: Column, green: Column, n: Column, percent: int = 40) -> Column:
    """Red if percent of the votes are, else green if as many are, else yellow."""
    return F.when((n > 0) & (red * 100 >= n * percent), RED).when((n > 0) & (green * 100 >= n * percent), GREEN).otherwise(YELLOW)


def is_legacy(year: Column, as_of_year: int) -> Column:
    return year < F.lit(as_of_year)


def provenance(kind: Column, year: Column, age: Column) -> Column:
    """A sentence on where a price comes from."""
    old = F.when(age == 1, F.format_string("Preço real de %d (há 1 ano)", year)).otherwise(F.format_string("Preço real de %d (há %d anos)", year, age))
    return F.when(kind == "REAL_ATUAL", "Preço coletado no ano corrente").when(kind == "HISTORICO_BASE", old).when(kind == "PROXY", "Estimativa por localidade vizinha").otherwise("Sem informação de procedência")
