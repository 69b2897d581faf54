"""Product names, units and raw fields as expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accents of Portuguese names and their plain letters.
ACCENTED = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUC"
PARTICLES = ("de", "da", "do", "das", "dos", "e", "em", "com", "para", "a", "o", "as", "os", "no", "na")


def decimal_price(x: Column) -> Column:
    """A price written with a decimal comma or point, DECIMAL(14,4); anything else is null."""
    return F.nullif(F.replace(F.trim(x), F.lit(","), F.lit(".")), F.lit("")).try_cast("decimal(14,4)")


def first_filled(*columns: Column) -> Column:
    """The first column that is not null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def column_key(name: str) -> str:
    """A header in lower case with spaces and hyphens as underscores."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def fold(x: Column) -> Column:
    """Upper case without accents."""
    return F.translate(F.upper(x), ACCENTED, PLAIN)


def name_key(x: Column) -> Column:
    """Master-data key of a product name.

    Folded, without asterisks, spaces collapsed; a hyphen among spaces or
    between two letters is a space, other hyphens stay; none at the ends.
    """
    spaced = F.regexp_replace(fold(F.trim(x)), r"\s+", " ")
    parted = F.regexp_replace(spaced, r"\s-\s|(?<=[A-Z])-(?=[A-Z])", " ")
    return F.btrim(F.replace(parted, F.lit("*"), F.lit("")), F.lit(" -"))


def collapsed(x: Column) -> Column:
    """Upper case, white space collapsed."""
    return F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))


def match_key(x: Column) -> Column:
    """Lower case letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9à-ÿ ]", ""), " +", " "))


def by_rules(x: Column, rules: Iterable[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The value of the first pattern found in x, ignoring case."""
    tests = [F.when(x.rlike(f"(?i){pattern}"), F.lit(value)) for pattern, value in rules]
    return F.coalesce(*tests, otherwise if otherwise is not None else F.lit(None))


def title_case(x: Column, particles: Sequence[str] = PARTICLES) -> Column:
    """Each word capitalised, after hyphens too; particles that are not first stay lower."""
    words = F.split(F.lower(F.trim(x)), " +")
    capital = lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000))), "-")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*particles), w).otherwise(capital(w))), " ")


def display_name(x: Column, suffixes: Sequence[str] = ()) -> Column:
    """The part before a pipe, without a category suffix after a hyphen, spaces collapsed."""
    k = F.substring_index(x, "|", 1)
    for s in suffixes:
        k = F.regexp_replace(k, rf"(?i)\s+-\s+{s}\s*$", "")
    return F.trim(F.regexp_replace(k, r"\s+", " "))


def root_word(x: Column, stop: Sequence[str] = ()) -> Column:
    """First word of a name once stop words are gone, wherever they stand; a name of nothing else has an empty one."""
    k = fold(F.trim(x))
    if stop:
        k = F.trim(F.regexp_replace(k, rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(map(re.escape, stop))})(?![\p{{L}}\p{{N}}_])", " "))
    return F.split(k, r"\s+")[0]


def unit(x: Column, synonyms: Mapping[str, tuple[str, float]]) -> Column:
    """Struct of unit, factor to kg and whether it is known: a synonym, else "N kg", else as written."""
    k = F.lower(F.trim(x))
    kg = F.regexp_extract(k, r"^(\d+(?:[.,]\d+)?) ?kg$", 1)
    made = lambda u, f, ok: F.struct(F.lit(u).cast("string").alias("unit") if not isinstance(u, Column) else u.alias("unit"), (f if isinstance(f, Column) else F.lit(f)).cast("double").alias("factor"), F.lit(ok).alias("known"))
    tests = [F.when(k == s, made(u, f, True)) for s, (u, f) in synonyms.items()]
    return F.coalesce(*tests, F.when(kg != "", made("kg", F.replace(kg, F.lit(","), F.lit(".")).try_cast("double"), True)), made(k, None, False))


def row_hash(*columns: Column) -> Column:
    """SHA-256 of columns joined by a bar, nulls skipped."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def dedup_key(*columns: Column) -> Column:
    """MD5 of columns joined by a bar, nulls empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def repaired(x: Column) -> Column:
    """Text whose UTF-8 was once read as Latin-1, put right; other text as it is."""
    looks = x.rlike("[ÂÃ][\u0080-¿]") & ~x.rlike("[^\u0000-ÿ]")
    return F.when(looks, F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")).otherwise(x)


def keyword_category(name: Column, keywords: Mapping[str, Sequence[str]], category: Column, by_category: Mapping[str, str], other: str = "outros") -> Column:
    """A category whose keyword is a word of the name, else the one of its category, else other."""
    tokens = F.split(F.lower(name), r"[^a-zà-ÿ0-9]+")
    tests = [F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(key)) for key, words in keywords.items()]
    tests += [F.when(category == k, F.lit(v)) for k, v in by_category.items()]
    return F.coalesce(*tests, F.lit(other))


def bigrams(x: Column) -> Column:
    """Distinct neighbouring character pairs."""
    n = F.length(x)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams over the bigrams of both; 0 without any."""
    both = F.size(bigrams(a)) + F.size(bigrams(b))
    return F.when(both == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(bigrams(a), bigrams(b))) / both)


def search_score(query: Column, name: Column, least: float = 0.4) -> Column:
    """4 for the same folded name, 3 for a prefix, 2 for a part, else the Dice score above least, else 0."""
    q, n = fold(F.trim(query)), fold(F.trim(name))
    d = dice(q, n)
    return F.when(q == n, 4.0).when(n.startswith(q), 3.0).when(n.contains(q), 2.0).when(d > least, d).otherwise(0.0)


def labels(x: Column, names: Mapping[str, str], otherwise: str | None = None) -> Column:
    """A label for each code."""
    return reduce(lambda made, kv: made.when(x == kv[0], kv[1]), list(names.items())[1:], F.when(x == next(iter(names)), names[next(iter(names))])).otherwise(otherwise)
