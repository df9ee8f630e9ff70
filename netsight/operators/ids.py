"""Dense increasing ids without a single-task sort, in one write of the data."""

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsight.session import written_once

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
SAMPLES = 60
PART_ROWS = 4_000


def _comparable(df: DataFrame, order: list[str]) -> Column:
    """The order columns as one struct of numbers and texts; nulls come first, here and in Python."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.struct(*[(F.unix_micros(c) if isinstance(kinds[c], T.TimestampType) else F.col(c)).alias(c) for c in order])


@dataclass(frozen=True)
class Deal:
    """Ranges of the ``order`` columns that rows are dealt to; the same rows always go to the same range.

    ``order`` should be unique, so that no hot value fills one range.
    """

    order: tuple[str, ...]
    bounds: list[tuple]

    @staticmethod
    def of(df: DataFrame, order: list[str]) -> "Deal":
        """Ranges of about equal size, from a sample of some tens of keys for each.

        ``df`` is read twice, the order columns only, and must give the same rows each time.
        """
        rows = df.count()
        parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows // PART_ROWS)
        if parts == 1:
            return Deal(tuple(order), [])
        keys = df.select(_comparable(df, order).alias("k")).sample(fraction=min(1.0, SAMPLES * parts / rows), seed=7).collect()
        keys = sorted((tuple(r["k"]) for r in keys), key=lambda k: [(v is not None, v) for v in k])
        return Deal(tuple(order), [keys[len(keys) * i // parts] for i in range(1, parts)] if len(keys) >= parts else [])

    def part_of(self, df: DataFrame) -> Column:
        """The range of a row, by binary search over the bounds."""
        if not self.bounds:
            return F.lit(0)
        kind = df.select(_comparable(df, list(self.order)).alias("k")).schema["k"].dataType
        bounds = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind.fields, strict=True)]) for b in self.bounds])
        key, n = _comparable(df, list(self.order)), len(self.bounds)
        steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
        # the place grows by a step while the bound there is not above the key
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= n) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))

    def ordered(self, df: DataFrame) -> DataFrame:
        return df.repartitionById(len(self.bounds) + 1, self.part_of(df)).sortWithinPartitions(*self.order)

    def counts(self, df: DataFrame) -> list[int]:
        """Rows of every range, by partial sums: no row is moved."""
        found = {r["p"]: r["n"] for r in df.groupBy(self.part_of(df).alias("p")).agg(F.count("*").alias("n")).collect()}
        return [found.get(i, 0) for i in range(len(self.bounds) + 1)]


def with_ids(ordered: DataFrame, counts: list[int], start: int = 0, name: str = "id") -> DataFrame:
    """Add ``name`` = ``start`` + 1, 2, 3, … to rows that lie in their ranges; ``counts`` says how many each has.

    A task numbers its rows as it writes them, so a lost one is repeated with the same numbers.
    """
    offsets = F.array(*[F.lit(n) for n in accumulate(counts[:-1], initial=start + 1)]).cast("array<bigint>")
    row = F.monotonically_increasing_id()
    offset = F.get(offsets, F.shiftright("_row", _ROW_BITS).cast("int"))
    return (ordered.withColumn("_row", row)
            .withColumn(name, offset + F.col("_row").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_row"))


def number_stored(stored: DataFrame, order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """``stored`` in order and numbered. It must be a table: its key columns are read ahead of its rows."""
    deal = Deal.of(stored, order)
    return with_ids(deal.ordered(stored), deal.counts(stored), start, name)


def assign_ids(df: DataFrame, order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """Number rows in the order of the ``order`` columns; ``df`` is evaluated once."""
    return number_stored(written_once(df, "unordered"), order, start, name)


def number_runs(stored: DataFrame, order: list[str], size: str, start: int = 0, name: str = "id") -> tuple[DataFrame, int]:
    """(``stored`` with ``name`` = the first of the ``size`` ids that a row takes, sum of all sizes).

    Ids go up in ``order`` from ``start`` + 1. As in ``number_stored``, ranges are counted ahead, so no row waits for others but those of its range.
    """
    deal = Deal.of(stored, order)
    found = {r["p"]: r["n"] for r in stored.groupBy(deal.part_of(stored).alias("p")).agg(F.sum(size).alias("n")).collect()}
    sums = [found.get(i, 0) for i in range(len(deal.bounds) + 1)]
    offsets = F.array(*[F.lit(n) for n in accumulate(sums[:-1], initial=start + 1)]).cast("array<bigint>")
    upto = F.sum(size).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = stored.withColumn("_part", deal.part_of(stored)).withColumn(name, F.get(offsets, F.col("_part")) + upto - F.col(size))
    return numbered.drop("_part"), sum(sums)


def max_id(df: DataFrame, column: str = "id") -> DataFrame:
    """Largest id, 0 for an empty table, as a one-row frame."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint").alias("m"))
