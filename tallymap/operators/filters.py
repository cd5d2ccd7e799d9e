"""Row filters: by region, by entity list, by recency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymap.spec import Fact


def filter_region(fact: Fact, state: str | None = None, district: str | None = None) -> Fact:
    """Keep one state and/or one district; an absent filter keeps everything."""
    df = fact.df
    wide, middle = fact.spec.levels[:2]
    if state:
        df = df.filter(F.col(wide) == state)
    if district:
        df = df.filter(F.col(middle) == district)
    return fact.on(df)


def entity_values(fact: Fact, level: str, entities: Sequence) -> list[Column]:
    """Requested entities as literals of the level's type; what cannot be cast becomes NULL."""
    kind = fact.df.schema[level].dataType.simpleString()
    return [F.lit(str(e)).try_cast(kind) for e in entities]


def filter_entities(fact: Fact, level: str, entities: Sequence) -> Fact:
    if not entities:
        return fact.on(fact.df.filter(F.lit(False)))
    return fact.on(fact.df.filter(F.col(level).isin(*entity_values(fact, level, entities))))


def last_date(fact: Fact) -> Column:
    """Latest date of a fact table as a scalar subquery."""
    return fact.df.select(F.max(fact.spec.date_col)).scalar()


def recent_activity(fact: Fact, ref: Fact | None = None, days: int = 30) -> Fact:
    """Rows not older than ``days`` before the last date of ``ref`` (inclusive: days + 1 dates).

    The last date is fetched when this is called: only a literal reaches the files, so that
    a question about recent days does not read all of the history, and of a table in
    monthly folders only the folders of those months.
    """
    date = F.col(fact.spec.date_col)
    last = (ref or fact).df.agg(F.max((ref or fact).spec.date_col)).first()[0]
    since = F.date_sub(F.lit(last).cast("date"), days)
    recent = fact.df.filter(date >= since)
    if fact.spec.month_col:
        recent = recent.filter(F.col(fact.spec.month_col) >= F.trunc(since, "month"))
    return fact.on(recent)


def date_range(fact: Fact, days: int | None = None) -> Fact:
    """The last ``days`` of the table itself; None keeps all dates."""
    return fact if days is None else recent_activity(fact, fact, days)
