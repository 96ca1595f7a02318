"""One long series in many tasks: blocks of rows, halos around them, and scans of two levels.

A window by ticker alone is one task for each ticker, however long its series. Here rows
(ticker, i, ...), with ``i`` counting a ticker's rows from 0, are cut into blocks of ``SIZE`` rows:

* ``halo`` puts a row also in the next or the previous block where it stands near enough, so that
  windows by (ticker, block) see whole frames, and ``own`` drops those copies again;
* ``scans`` has running sums, counts, maxima and last values within a block, and adds what all blocks
  before it come to, which is a window over blocks, not rows;
* ``numbered`` makes ``i`` itself in the same two levels, from cells of the values that rows are ordered by.

Rows without a ticker belong to no series and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 8192


def _order(column: Column, kind: T.DataType, width: float | None) -> Column:
    """The cell of a value: 512 days, an hour, or SIZE of a number, unless ``width`` says how wide (in days, seconds, units)."""
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(column) / (width or 512))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(column.cast("timestamp")) / (1e6 * (width or 3600)))
    return F.floor(column / (width or SIZE))


def numbered(rows: DataFrame, order: str, keys: tuple[str, ...] = ("ticker",), out: str = "i", width: float | None = None) -> DataFrame:
    """Adds ``out``: a row's place among those with its keys, from 0. Orders don't repeat within keys, and aren't null."""
    x = rows.withColumn("__cell", _order(F.col(order), rows.schema[order].dataType, width))
    counts = x.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.select(*keys, "__cell", ahead.alias("__ahead"))
    place = F.row_number().over(W.partitionBy(*keys, "__cell").orderBy(order)) - 1
    return x.join(ahead, [*keys, "__cell"]).withColumn(out, F.col("__ahead") + place).select(*[c for c in rows.columns if c != out], out)


def in_blocks(rows: DataFrame, size: int | None = None) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("i") / (size or SIZE)))


def halo(rows: DataFrame, before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Rows with ``block``: their own, and those that see them among the ``before`` rows ahead of theirs or the ``after`` rows past them."""
    first, last = F.floor(F.greatest(F.col("i") - after, F.lit(0)) / (size or SIZE)), F.floor((F.col("i") + before) / (size or SIZE))
    return rows.withColumn("block", F.explode(F.sequence(first, last)))


def own(rows: DataFrame, size: int | None = None) -> DataFrame:
    return rows.where(F.col("block") == F.floor(F.col("i") / (size or SIZE))).drop("block")


def inside(order: str = "i"):
    return W.partitionBy("ticker", "block").orderBy(order)


def up_to(order: str = "i"):
    return inside(order).rowsBetween(W.unboundedPreceding, 0)


def spread(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (with block) joined to a table of one row for each ticker, by (ticker, block): a long ticker's rows meet its row in many tasks."""
    return rows.join(rows.select("ticker", "block").distinct().join(table, "ticker"), ["ticker", "block"])


def scans(rows: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """Adds columns to rows (ticker, block, i, ...): ``out=(kind, value)``.

    Kinds: sum, count and max of the values up to a row, last value up to it and next value from it (none of them null),
    and of a ticker's whole series its mean, its std (of a sample), its total and its n (values that aren't null).
    Sums pass over nulls, and are null before the first value.
    """
    t, ahead = W.partitionBy("ticker"), W.partitionBy("ticker").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("ticker").orderBy("block").rowsBetween(1, W.unboundedFollowing)
    parts, carries, spreads, out = [], [], [], {}
    for k, (name, (kind, value)) in enumerate(wanted.items()):
        v, p, c = F.col(value), f"__p{k}", F.col(f"__c{k}")
        at = F.when(v.isNotNull(), F.col("i"))
        if kind in ("sum", "total"):
            parts.append(F.sum(v).alias(p))
            carries.append(F.sum(p).over(ahead if kind == "sum" else t).alias(f"__c{k}"))
            here = F.sum(v).over(up_to())
            out[name] = F.coalesce(here + c, here, c) if kind == "sum" else c
        elif kind in ("count", "n"):
            parts.append(F.count(v).alias(p))
            carries.append(F.coalesce(F.sum(p).over(ahead if kind == "count" else t), F.lit(0)).alias(f"__c{k}"))
            out[name] = F.count(v).over(up_to()) + c if kind == "count" else c
        elif kind == "max":
            parts.append(F.max(v).alias(p))
            carries.append(F.max(p).over(ahead).alias(f"__c{k}"))
            out[name] = F.greatest(F.max(v).over(up_to()), c)
        elif kind == "last":
            parts.append(F.max_by(v, at).alias(p))
            carries.append(F.last(p, ignorenulls=True).over(ahead).alias(f"__c{k}"))
            out[name] = F.coalesce(F.last(v, ignorenulls=True).over(up_to()), c)
        elif kind == "next":
            parts.append(F.min_by(v, at).alias(p))
            carries.append(F.first(p, ignorenulls=True).over(later).alias(f"__c{k}"))
            out[name] = F.coalesce(F.first(v, ignorenulls=True).over(inside().rowsBetween(0, W.unboundedFollowing)), c)
        elif kind in ("mean", "std"):
            parts += [F.count(v).alias(f"__n{k}"), F.avg(v).alias(p), F.var_pop(v).alias(f"__v{k}")]
            mean = F.try_divide(F.sum(F.col(f"__n{k}") * F.col(p)).over(t), F.sum(f"__n{k}").over(t))
            carries += [mean.alias(f"__c{k}"), f"__n{k}", p, f"__v{k}"]
            if kind == "std":
                off = F.col(p) - F.col(f"__c{k}")
                squares = F.sum(F.col(f"__n{k}") * (F.col(f"__v{k}") + off * off)).over(t)
                spreads.append((f"__c{k}", F.when(F.sum(f"__n{k}").over(t) > 1, F.sqrt(squares / (F.sum(f"__n{k}").over(t) - 1)))))
            out[name] = c
        else:
            raise ValueError(f"no scan of kind {kind}")
    carried = rows.groupBy("ticker", "block").agg(*parts).select("ticker", "block", *carries)
    for name, value in spreads:
        carried = carried.withColumn(name, value)
    got = rows.join(carried.select("ticker", "block", *[f"__c{k}" for k in range(len(wanted))]), ["ticker", "block"])
    return got.select(*[c for c in rows.columns if c not in wanted], *[v.alias(name) for name, v in out.items()])
