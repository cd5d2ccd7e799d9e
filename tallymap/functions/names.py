"""Region-name cleaning as native column expressions.

The rules need no shuffle: they are evaluated where the row is, and only rows
that miss the exact lookups reach the containment search.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.functions.name_tables import ALIASES, INVALID_NAMES, UNKNOWN

Aliases = Sequence[tuple[str, str]]

# Fixed value: the characters that count as white space at the ends of a name.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def title_case(text: Column) -> Column:
    """Capital after every character that is not a letter (``o'neil x`` -> ``O'Neil X``)."""
    pieces = F.split(F.lower(text), f"(?<=[^{_CASED}])|(?=[^{_CASED}])")
    capital = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    # Most names are letters and blanks, where only blanks begin a word.
    return F.when(text.rlike("^[A-Za-z ]*$"), F.initcap(text)).otherwise(F.array_join(capital, ""))


class _Table:
    """The aliases as constant arrays: one expression for all of them, so that generated code stays small."""

    def __init__(self, aliases: Aliases) -> None:
        official: dict[str, str] = {}
        for key, name in aliases:
            official.setdefault(key, name)
        self.keys = list(official)
        self.array = F.array(*map(F.lit, self.keys))
        self.names = F.map_from_arrays(self.array, F.array(*map(F.lit, official.values())))

    def exact(self, key: Column) -> Column:
        """Official name of the alias, else NULL."""
        return F.try_element_at(self.names, key)

    def inside(self, key: Column) -> Column:
        """Official name of the first alias that contains the key or is contained in it, else NULL."""
        found = F.filter(self.array, lambda k: F.contains(key, k) | F.contains(k, key))
        return self.exact(F.get(found, F.lit(0)))


def region_name(
    raw: Column,
    cleaned: Column,
    key: Column,
    aliases: Aliases = ALIASES,
    invalid: Iterable[str] = INVALID_NAMES,
    strict: bool = False,
) -> Column:
    """Official name of a region; ``cleaned`` and ``key`` are the stripped and the lower-case name.

    Rules, first hit wins: missing -> Unknown; a known wrong entry or a number
    -> Unknown; exact alias; first alias (in table order) that contains the
    name or is contained in it; else the name in title case.  ``strict`` turns
    blank names into Unknown and leaves out the containment rule.
    """
    names = dict(aliases)
    wrong = set(invalid)
    # Most rows carry an official name already; one hash lookup settles them.
    official = [n for n in dict.fromkeys(names.values()) if names.get(n.lower()) == n and n.lower() not in wrong]
    table = _Table(aliases)
    exact, inside = table.exact(key), table.inside(key)
    unknown = raw.isNull() | ((key if strict else raw) == "") | key.isin(*wrong) | key.rlike(r"^\p{Nd}+$")
    fallback = [title_case(cleaned)] if strict else [inside, title_case(cleaned)]
    return (
        F.when(raw.isin(*official), raw)
        .when(unknown, F.lit(UNKNOWN))
        .otherwise(F.coalesce(exact, *fallback))
    )


def normalize_region_name(
    df: DataFrame,
    column: str = "state",
    aliases: Aliases = ALIASES,
    invalid: Iterable[str] = INVALID_NAMES,
    strict: bool = False,
) -> DataFrame:
    """Replace a name column by the official names.

    The stripped and the lower-case text get columns of their own first, so the
    rules do not repeat that work for every alias.
    """
    cleaned, key = f"{column}__cleaned", f"{column}__key"
    rules = region_name(F.col(column), F.col(cleaned), F.col(key), aliases, invalid, strict)
    return (
        df.withColumn(cleaned, strip(F.col(column)))
        .withColumn(key, F.lower(cleaned))
        .withColumn(column, rules)
        .drop(cleaned, key)
    )


def official_names(
    df: DataFrame,
    column: str = "state",
    aliases: Aliases = ALIASES,
    invalid: Iterable[str] = INVALID_NAMES,
    strict: bool = False,
) -> DataFrame:
    """(raw, official) for every distinct name of a column that is not missing: the rules run once per name."""
    raw = df.select(F.col(column).alias("raw")).where(F.col("raw").isNotNull()).distinct()
    return normalize_region_name(raw.withColumn("official", F.col("raw")), "official", aliases, invalid, strict)


def normalize_by_value(
    df: DataFrame,
    column: str = "state",
    aliases: Aliases = ALIASES,
    invalid: Iterable[str] = INVALID_NAMES,
    strict: bool = False,
) -> DataFrame:
    """As ``normalize_region_name``, by a join with the cleaned distinct names.

    For stored or aggregated frames: the column is read twice.  How the join runs is left to Spark's size check;
    a name that most rows share is split by adaptive execution.
    """
    found = official_names(df, column, aliases, invalid, strict).select(
        F.col("raw").alias("__raw"), F.col("official").alias("__official")
    )
    joined = df.join(found, F.col(column) == F.col("__raw"), "left")
    official = F.coalesce("__official", F.lit(UNKNOWN))
    return joined.withColumn(column, official).drop("__raw", "__official")
