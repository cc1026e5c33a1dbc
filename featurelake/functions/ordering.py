"""Global order, exact ranks and bounded look-back frames without a single hot task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from featurelake.session import cut_lineage

_STAMP = "__stamp"
_PART = "__part"
_LOCAL_BITS = 33
# Values of a bracket that one aggregate may sort, and steps of a rank sketch.
EXACT_LIMIT, ACCURACY = 10_000, 10_000


def _stamped(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Range-partitioned, sorted and materialised rows with a (partition, row) stamp.

    The stamp is stored with the rows, so later stages never depend on how Spark would place them a
    second time.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return cut_lineage(
        ranged.sortWithinPartitions(*order).withColumn(_STAMP, F.monotonically_increasing_id())
    )


def _part_of() -> Column:
    return F.shiftright(F.col(_STAMP), _LOCAL_BITS)


def _row_in_part() -> Column:
    return F.col(_STAMP).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))


def _exclusive_offsets(totals: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Running sum over the partitions before each one; one row per partition, hence tiny."""
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        _PART, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in cols]
    )


def global_index(df: DataFrame, order: Sequence[Column], name: str = "idx",
                 partitions: int | None = None) -> DataFrame:
    """Dense 0-based position in a total order.

    One range shuffle; the order has to be unique, so that a value holding many rows is split by
    its tie-break columns. Partition offsets are one row per task.
    """
    stamped = _stamped(df, order, partitions)
    sizes = stamped.groupBy(_part_of().alias(_PART)).agg(F.count(F.lit(1)).alias("n"))
    offsets = F.broadcast(_exclusive_offsets(sizes, ["n"]))
    return (
        stamped.withColumn(_PART, _part_of())
        .join(offsets, _PART)
        .withColumn(name, _row_in_part() + F.col("__before_n"))
        .drop(_STAMP, _PART, "__before_n")
    )


def running_total(df: DataFrame, order: Sequence[Column], sums: dict[str, str],
                  partitions: int | None = None) -> DataFrame:
    """Inclusive running sums over a total order: ``sums`` maps output name to input column."""
    stamped = _stamped(df, order, partitions).withColumn(_PART, _part_of())
    totals = stamped.groupBy(_PART).agg(*[F.sum(c).alias(o) for o, c in sums.items()])
    offsets = F.broadcast(_exclusive_offsets(totals, list(sums)))
    inside = Window.partitionBy(_PART).orderBy(_STAMP).rowsBetween(Window.unboundedPreceding, 0)
    return (
        stamped.join(offsets, _PART)
        .withColumns({o: F.sum(c).over(inside) + F.col(f"__before_{o}") for o, c in sums.items()})
        .drop(_STAMP, _PART, *[f"__before_{o}" for o in sums])
    )


def overlap_buckets(df: DataFrame, position: Column, width: int, lookback: int,
                    bucket: str = "bucket", copied: str = "is_copy") -> DataFrame:
    """Cut an ordered axis into buckets, each also holding the ``lookback`` positions before it.

    A window partitioned by the bucket then sees every row a frame of that length needs; rows
    flagged as copies are context only and are dropped afterwards.
    """
    if not 0 < lookback <= width:
        raise ValueError("lookback must be positive and at most the bucket width")
    home = F.floor(position / F.lit(width))
    spills = F.pmod(position, F.lit(width)) >= width - lookback
    slots = F.array_compact(F.array(
        F.struct(home.alias(bucket), F.lit(False).alias(copied)),
        F.when(spills, F.struct((home + 1).alias(bucket), F.lit(True).alias(copied))),
    ))
    return df.select("*", F.inline(slots))


def tail_rows(df: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """Last ``n`` rows by arrival.

    For a time column a count per day finds the earliest day that can matter; the filter on it
    reaches the scan, so only the newest files take part in the ordered limit. Any other order
    column goes straight to the ordered limit. Rows without a time count as the oldest.
    """
    if not isinstance(df.schema[ts].dataType, (DateType, TimestampType, TimestampNTZType)):
        return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    newer = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0))
    needed = days.select("day", newer.alias("newer")).where(F.col("newer") < n)
    cutoff, timeless = needed.agg(F.min("day"), F.count_if(F.col("day").isNull())).first()
    whole = cutoff is None or timeless
    recent = df if whole else df.where(F.col(ts) >= F.lit(cutoff).cast(df.schema[ts].dataType))
    return recent.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def hash_parts(df: DataFrame, label: str, key: str, cuts: Sequence[Column], seed: int = 42,
               name: str = "part", prefix: int = 4) -> DataFrame:
    """Exact seeded split inside each class.

    Rows of a class are ranked by a hash of their key; ``cuts`` are columns over ``n`` (class
    size) giving increasing rank boundaries, and the result column counts the boundaries at or
    below the row's rank. Counting rows per hash prefix shows which prefix each boundary falls
    into, and ranking the rows of those prefixes alone (about 1 in 16**prefix each) gives the hash
    and key at which each boundary lies. Then one scan labels all rows by comparing with them: no
    class is ever sorted, and no row is shuffled for its label.
    """
    hashed = df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))))
    narrow = hashed.select(F.col(label).alias("__label"), "__h", F.col(key).alias("__key"),
                           F.substring("__h", 1, prefix).alias("__bucket"))
    counts = narrow.groupBy("__label", "__bucket").agg(F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("__label")
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select("__label", "__bucket", "m", F.sum("m").over(whole).alias("n"),
                          F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    # Where each boundary lies: its prefix and the rank inside it. A boundary behind all rows has none.
    places = spans.select("__label", "__bucket", "m", F.posexplode(F.array(*[c - F.col("first") for c in cuts])).alias("__i", "__rank"))
    places = cut_lineage(places.where((F.col("__rank") >= 0) & (F.col("__rank") < F.col("m"))).drop("m"))
    torn = narrow.alias("r").join(
        places.select("__label", "__bucket").distinct().alias("p"),
        F.col("r.__label").eqNullSafe(F.col("p.__label")) & (F.col("r.__bucket") == F.col("p.__bucket")), "left_semi")
    order = Window.partitionBy("__label", "__bucket").orderBy("__h", "__key")
    ranked = torn.withColumn("__rank", (F.row_number().over(order) - 1).cast("bigint"))
    met = ranked.alias("r").join(
        places.alias("p"), F.col("r.__label").eqNullSafe(F.col("p.__label")) & (F.col("r.__bucket") == F.col("p.__bucket"))
        & (F.col("r.__rank") == F.col("p.__rank")))
    edge = [F.max(F.when(F.col("__i") == i, F.struct("__h", "__key"))).alias(f"__edge{i}") for i in range(len(cuts))]
    edges = cut_lineage(met.select("r.__label", "__h", "__key", "__i").groupBy("__label").agg(*edge))
    joined = hashed.join(edges, F.col(label).eqNullSafe(F.col("__label")), "left")
    here = F.struct(F.col("__h").alias("__h"), F.col(key).alias("__key"))
    part = sum((F.when(F.coalesce(here >= F.col(f"__edge{i}"), F.lit(False)), 1).otherwise(0) for i in range(len(cuts))), F.lit(0))
    return joined.withColumn(name, part).select(*df.columns, name)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], exact_limit: int = EXACT_LIMIT,
                    accuracy: int = ACCURACY, sizes: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of many columns with bounded state; nulls and NaN are missing.

    A sketch brackets every wanted rank and one scan counts what lies below the bracket; only the
    bracket's own values are bracketed again, until it holds one value or at most ``exact_limit``,
    which one aggregate then sorts. Every round is a one-row aggregate, so no task ever holds a whole
    column. Known counts of present values can be given as ``sizes`` to save their scan.
    """
    if not cols:
        return {}
    if sizes is None:
        sizes = df.agg(*[F.count(present(c)).alias(c) for c in cols]).first().asDict()
    sizes = {c: sizes[c] for c in cols}
    ranks = {c: {r for p in probs for r in rank_neighbours(p, n)} for c, n in sizes.items() if n}
    return quantiles_at(values_at_ranks(df, ranks, sizes, exact_limit, accuracy), sizes, probs)


def quantiles_at(found: dict[tuple[str, int], float], sizes: dict[str, int], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles from the values at the ranks next to them."""
    result: dict[str, list[float | None]] = {}
    for c, n in sizes.items():
        result[c] = []
        for p in probs:
            if not n:
                result[c].append(None)
                continue
            lo, hi = rank_neighbours(p, n)
            a, b = found[c, lo], found[c, hi]
            part = p * (n - 1) - lo
            if a == b or not part:
                result[c].append(a)
            elif math.isinf(a) or math.isinf(b):
                result[c].append(a * (1 - part) + b * part)  # an infinite neighbour decides; two of them have no middle
            else:
                result[c].append(a + (b - a) * part)
    return result


def present(c: str) -> Column:
    """A number as double, null where it is missing: null or NaN."""
    value = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(value), value)


def rank_neighbours(p: float, n: int) -> tuple[int, int]:
    lo = int(p * (n - 1))
    return lo, min(lo + 1, n - 1)


def values_at_ranks(df: DataFrame, ranks: dict[str, set[int]], sizes: dict[str, int], exact_limit: int = EXACT_LIMIT,
                    accuracy: int = ACCURACY) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank, narrowing open intervals round by round; ranks in the same
    interval share its sketch.

    The sketch is within ``1 / accuracy`` of a rank, so two such steps to each side always enclose
    it. Rows equal to an interval's ends are counted, not kept: a value holding most rows ends the
    search at once instead of filling the interval.
    """
    found: dict[tuple[str, int], float] = {}
    # (column, exclusive low, exclusive high, rows at or below low, rows inside) -> wanted ranks
    spans = {(c, None, None, 0, sizes[c]): sorted(rs) for c, rs in ranks.items()}
    while spans:
        aggs = []
        for i, ((c, lo, hi, below, inside), wanted) in enumerate(spans.items()):
            value = present(c)
            scoped = value if lo is None else F.when((value > lo) & (value < hi), value)
            if inside <= exact_limit:
                # At most exact_limit values: sort them and take each rank by its number.
                held = F.array_sort(F.collect_list(scoped))
                aggs.append(F.array(*[F.get(held, F.lit(r - below)) for r in wanted]).alias(f"v{i}"))
            else:
                step = 2 / accuracy
                ends = [e for r in wanted for e in ((r - below) / inside - step, (r - below) / inside + step)]
                aggs.append(F.percentile_approx(scoped, [min(1.0, max(0.0, e)) for e in ends], accuracy).alias(f"v{i}"))
        sketch = df.agg(*aggs).first()
        brackets: dict[tuple[str, float, float], list[int]] = {}
        for i, ((c, _, _, _, inside), wanted) in enumerate(spans.items()):
            values = sketch[f"v{i}"]
            for j, rank in enumerate(wanted):
                if inside <= exact_limit:
                    found[c, rank] = values[j]
                else:
                    brackets.setdefault((c, values[2 * j], values[2 * j + 1]), []).append(rank)
        if not brackets:
            break
        counts = []
        for i, (c, lo, hi) in enumerate(brackets):
            value = present(c)
            counts += [F.count_if(value < lo).alias(f"lt{i}"), F.count_if(value <= lo).alias(f"le{i}"),
                       F.count_if(value < hi).alias(f"lth{i}"), F.count_if(value <= hi).alias(f"leh{i}")]
        row = df.agg(*counts).first()
        spans = {}
        for i, ((c, lo, hi), wanted) in enumerate(brackets.items()):
            for rank in wanted:
                if not row[f"lt{i}"] <= rank < row[f"leh{i}"]:
                    raise RuntimeError(f"rank {rank} of {c} lies outside its bracket [{lo}, {hi}]")
                if rank < row[f"le{i}"]:
                    found[c, rank] = lo
                elif rank >= row[f"lth{i}"]:
                    found[c, rank] = hi
                else:
                    span = (c, lo, hi, row[f"le{i}"], row[f"lth{i}"] - row[f"le{i}"])
                    spans.setdefault(span, []).append(rank)
    return found


def values_in_brackets(df: DataFrame, brackets: dict[tuple[str, float, float], list[int]], sizes: dict[str, int],
                       exact_limit: int = EXACT_LIMIT) -> tuple[dict[tuple[str, int], float], dict[str, set[int]]]:
    """Values at ranks that given brackets (column, low, high) should enclose, and the ranks they do not settle.

    One pass counts the rows below, at and inside every bracket; a second one takes the ranks from the sorted values of those
    that hold at most ``exact_limit``. Ranks outside their bracket, or in a larger one, are left over.
    """
    aggs, kept = [], {}
    for i, (c, lo, hi) in enumerate(brackets):
        value = present(c)
        aggs += [F.count_if(value < lo).alias(f"lt{i}"), F.count_if(value <= lo).alias(f"le{i}"),
                 F.count_if(value < hi).alias(f"lth{i}"), F.count_if(value <= hi).alias(f"leh{i}")]
    counts = df.agg(*aggs).first() if aggs else None
    found: dict[tuple[str, int], float] = {}
    missed: dict[str, set[int]] = {}
    for i, ((c, lo, hi), wanted) in enumerate(brackets.items()):
        inside = counts[f"lth{i}"] - counts[f"le{i}"]
        for rank in wanted:
            if not counts[f"lt{i}"] <= rank < counts[f"leh{i}"]:
                missed.setdefault(c, set()).add(rank)
            elif rank < counts[f"le{i}"]:
                found[c, rank] = lo
            elif rank >= counts[f"lth{i}"]:
                found[c, rank] = hi
            elif inside <= exact_limit:
                kept.setdefault((c, lo, hi, counts[f"le{i}"]), []).append(rank)
            else:
                missed.setdefault(c, set()).add(rank)
    if kept:
        row = df.agg(*[F.array(*[F.get(F.array_sort(F.collect_list(F.when((present(c) > lo) & (present(c) < hi), present(c)))), F.lit(r - below))
                                 for r in wanted]).alias(f"v{i}") for i, ((c, lo, hi, below), wanted) in enumerate(kept.items())]).first()
        for i, ((c, _, _, _), wanted) in enumerate(kept.items()):
            found.update({(c, r): row[f"v{i}"][j] for j, r in enumerate(wanted)})
    return found, missed
