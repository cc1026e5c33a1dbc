"""From a wide, year-suffixed table to clean long entity-year rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, NumericType, StringType

from featurelake.functions.ordering import EXACT_LIMIT, exact_quantiles, present
from featurelake.functions.scalars import safe_ratio, to_number
from featurelake.session import cut_lineage

# Identifier columns, known years, tracked indexes, year key and filler text.
IDENTIFIER_COLUMNS = ["NOME"]
KNOWN_YEARS = ["2020", "2021", "2022", "2023", "2024"]
STACKED_YEARS = ["2020", "2021", "2022"]
TRACKED_INDEXES = ["INDE", "IPV", "IAA", "IEG", "IPS", "IDA", "IPP", "IAN"]
YEAR_KEY = "YEAR_REF"
UNKNOWN_TEXT = "Desconhecido"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


# -- year slices ---------------------------------------------------------------------------------


def year_columns(columns: Sequence[str], year: str, known_years: Sequence[str] = KNOWN_YEARS) -> dict[str, str]:
    """Output name -> input column of one year's slice.

    The year is a suffix at the end of a name. Where both ``X`` and ``X_<year>`` exist, the
    suffixed one is the value of that year.
    """
    mine = f"_{year}"
    others = tuple(f"_{y}" for y in known_years if y != year)
    picked: dict[str, str] = {}
    for name in columns:
        if name.endswith(others):
            continue
        if name.endswith(mine):
            picked[name.removesuffix(mine)] = name
        else:
            picked.setdefault(name, name)
    return picked


def year_slice(df: DataFrame, year: str, known_years: Sequence[str] = KNOWN_YEARS) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(n) for n, c in year_columns(df.columns, year, known_years).items()])


def _common_type(kinds: Sequence[DataType]) -> DataType:
    if len(set(kinds)) == 1:
        return kinds[0]
    return DoubleType() if all(isinstance(k, NumericType) for k in kinds) else StringType()


def stack_years(df: DataFrame, years: Sequence[str], known_years: Sequence[str] = KNOWN_YEARS,
                tracked: Sequence[str] = (), velocity: Sequence[str] | None = None) -> DataFrame:
    """All yearly slices below each other in one scan of the wide table.

    Every row becomes an array of one struct per year and is unfolded in place, so nothing is
    shuffled or read twice. Columns a year lacks are null. For tracked indexes the later years
    carry delta and velocity against the year before; the first year has none (null).
    """
    known = list(dict.fromkeys([*known_years, *years]))
    slices = {y: year_columns(df.columns, y, known) for y in years}
    names = list(dict.fromkeys(n for s in slices.values() for n in s))
    velocity = list(tracked) if velocity is None else list(velocity)
    kinds = {n: _common_type([df.schema[s[n]].dataType for s in slices.values() if n in s]) for n in names}
    tracked_pairs = [t for t in tracked if any(
        t in slices[y] and t in slices[p] for p, y in zip(years, years[1:]))]

    def record(i: int, year: str) -> Column:
        cols = [
            (F.col(f"`{slices[year][n]}`") if n in slices[year] else F.lit(None)).cast(kinds[n]).alias(n)
            for n in names
        ] + [F.lit(int(year)).alias(YEAR_KEY)]
        for t in tracked_pairs:
            pair = i > 0 and t in slices[year] and t in slices[years[i - 1]]
            cur = to_number(F.col(f"`{slices[year][t]}`")) if pair else F.lit(None)
            prev = to_number(F.col(f"`{slices[years[i - 1]][t]}`")) if pair else F.lit(None)
            cols.append((delta(cur, prev) if pair else F.lit(None).cast("double")).alias(f"{t}_delta"))
            if t in velocity:
                cols.append((relative_delta(cur, prev) if pair else F.lit(None).cast("double")).alias(f"{t}_velocity"))
        return F.struct(*cols)

    return df.select(F.inline(F.array(*[record(i, y) for i, y in enumerate(years)])))


# -- year over year ------------------------------------------------------------------------------


def delta(cur: Column, prev: Column) -> Column:
    """cur - prev; 0 when either side is missing."""
    return F.coalesce(cur - prev, F.lit(0.0))


def relative_delta(cur: Column, prev: Column) -> Column:
    """(cur - prev) / prev; 0 when a side is missing or prev is 0."""
    return F.coalesce(safe_ratio(cur - prev, prev), F.lit(0.0))


def yoy_wide(df: DataFrame, year: str, previous: str, indexes: Sequence[str]) -> DataFrame:
    """Delta and velocity columns from two years of the same wide row."""
    cols = {}
    for i in indexes:
        cur, prev = to_number(F.col(f"{i}_{year}")), to_number(F.col(f"{i}_{previous}"))
        cols[f"{i}_delta"], cols[f"{i}_velocity"] = delta(cur, prev), relative_delta(cur, prev)
    return df.withColumns(cols)


def yoy_lag(df: DataFrame, entity: str, year: str, indexes: Sequence[str]) -> DataFrame:
    """Delta and velocity against the row of the year before.

    Input holds one row per (entity, year), so a window group is as small as the number of years.
    """
    w = Window.partitionBy(entity).orderBy(year)
    follows = F.lag(year).over(w) == F.col(year) - 1
    cols = {}
    for i in indexes:
        cur, prev = to_number(F.col(i)), F.when(follows, to_number(F.lag(i).over(w)))
        cols[f"{i}_delta"], cols[f"{i}_velocity"] = delta(cur, prev), relative_delta(cur, prev)
    return df.withColumns(cols)


def yoy_self_join(df: DataFrame, entity: str, year: str, indexes: Sequence[str]) -> DataFrame:
    """The same result by an equi-join on (entity, year - 1); its key is unique, so never skewed."""
    prev = df.select(F.col(entity), (F.col(year) + 1).alias(year),
                     *[to_number(F.col(i)).alias(f"__prev_{i}") for i in indexes])
    joined = df.join(prev, [entity, year], "left")
    cols = {}
    for i in indexes:
        cur, before = to_number(F.col(i)), F.col(f"__prev_{i}")
        cols[f"{i}_delta"], cols[f"{i}_velocity"] = delta(cur, before), relative_delta(cur, before)
    return joined.withColumns(cols).drop(*[f"__prev_{i}" for i in indexes])


# -- cleaning and imputation ---------------------------------------------------------------------


def clean_rows(df: DataFrame, identifiers: Sequence[str] = IDENTIFIER_COLUMNS, min_filled: float = 0.5,
               not_evidence: Sequence[str] = ()) -> DataFrame:
    """Drop identifiers, rows without any number, and rows filled below the share.

    Exactly the share is kept. A frame without numeric columns skips the first test.
    ``not_evidence`` names numeric columns (such as a year key) that say nothing about a row.
    """
    df = df.drop(*[c for c in identifiers if c in df.columns])
    numeric = [c for c in numeric_columns(df) if c not in not_evidence]
    if numeric:
        df = df.dropna(how="all", subset=numeric)
    return df.dropna(thresh=math.ceil(min_filled * len(df.columns)))


def column_medians(df: DataFrame, columns: Sequence[str] | None = None, exact_limit: int = EXACT_LIMIT,
                   sizes: dict[str, int] | None = None) -> dict[str, float]:
    """Exact medians of the numeric columns, missing numbers left out."""
    columns = numeric_columns(df) if columns is None else columns
    medians = exact_quantiles(df, columns, [0.5], exact_limit, sizes=sizes)
    return {c: m[0] for c, m in medians.items() if m[0] is not None}


def impute_median(df: DataFrame, medians: Mapping[str, float] | None = None,
                  exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """Fill missing numbers (null or NaN) by the column's median.

    Medians come from this very frame unless fitted ones are given. Only columns that have gaps
    are touched; the others keep their type. Without given medians the frame is evaluated twice
    before the fill, so hand over a stored or persisted one when it is costly.
    """
    if medians is None:
        numeric = numeric_columns(df)
        if not numeric:
            return df
        counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(present(c)).alias(c) for c in numeric]).first().asDict()
        gaps = [c for c in numeric if counts[c] < counts["__rows"]]
        medians = column_medians(df, gaps, exact_limit, counts)
    return df.withColumns({
        c: F.coalesce(present(c), F.lit(float(m))) for c, m in medians.items() if c in df.columns
    }) if medians else df


def impute_text(df: DataFrame, value: str = UNKNOWN_TEXT) -> DataFrame:
    return df.fillna(value, subset=text_columns(df))


class Preparer:
    """Column roles learned by ``fit``; ``transform`` cleans and imputes.

    ``impute="frame"`` takes the medians from the frame being transformed, ``"fitted"`` reuses those
    of the frame seen by ``fit``.
    """

    def __init__(self, identifiers: Sequence[str] = IDENTIFIER_COLUMNS, not_evidence: Sequence[str] = (),
                 impute: str = "frame"):
        if impute not in ("frame", "fitted"):
            raise ValueError("impute must be 'frame' or 'fitted'")
        self.identifiers = list(identifiers)
        self.not_evidence = list(not_evidence)
        self.impute = impute
        self.numeric: list[str] | None = None
        self.text: list[str] | None = None
        self.medians: dict[str, float] | None = None

    def fit(self, df: DataFrame) -> Preparer:
        self.numeric, self.text = numeric_columns(df), text_columns(df)
        if self.impute == "fitted":
            self.medians = column_medians(clean_rows(df, self.identifiers, not_evidence=self.not_evidence))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.numeric is None:
            raise ValueError("fit the preparer before transforming")
        df = clean_rows(df, self.identifiers, not_evidence=self.not_evidence)
        if self.medians is None:
            # Medians take several looks at the rows: store them once instead of preparing them anew.
            df = cut_lineage(df)
        return impute_text(impute_median(df, self.medians))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def prepare_year(df: DataFrame, year: str, known_years: Sequence[str] = KNOWN_YEARS,
                 preparer: Preparer | None = None) -> DataFrame:
    """Slice one year, clean, impute."""
    return (preparer or Preparer()).fit_transform(year_slice(df, year, known_years))


def prepare_dataset(df: DataFrame, year: str = "2022", **settings) -> DataFrame:
    """One year, or all stacked years for ``year="all"``."""
    return prepare_multiyear(df, **settings) if year == "all" else prepare_year(df, year, **settings)


def prepare_multiyear(df: DataFrame, years: Sequence[str] = STACKED_YEARS, known_years: Sequence[str] = KNOWN_YEARS,
                      tracked: Sequence[str] = TRACKED_INDEXES, velocity: Sequence[str] | None = None,
                      first_year: str = "median", preparer: Preparer | None = None) -> DataFrame:
    """Stack the years with their deltas, clean, impute.

    First-year rows have no deltas: ``first_year="median"`` lets them take the median of the later
    years like any other missing number, ``"zero"`` sets them to 0.
    """
    if first_year not in ("median", "zero"):
        raise ValueError("first_year must be 'median' or 'zero'")
    stacked = stack_years(df, years, known_years, tracked, velocity)
    if first_year == "zero":
        fresh = [c for c in stacked.columns if c.endswith(("_delta", "_velocity"))]
        stacked = stacked.fillna(0.0, subset=fresh)
    return (preparer or Preparer()).fit_transform(stacked)
