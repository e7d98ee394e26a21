"""Runs of like rows in series that are too long for one task.

A series is cut into stretches of periods. Runs are found within each stretch; a stretch is then one row that says how many runs it has and how its first and last
one begin and end. Only these rows, a ``stretch``-th of the data, are put in order by entity: a run that goes on where a stretch begins has the number that it had before, and
the sizes of its parts are added up. So one run may cross any number of stretches, and no task sees more of an entity than one stretch and the short rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 17


def with_runs(df: DataFrame, same, columns: tuple[str, ...], stretch: int = STRETCH, entity: str = "entity", order: str = "period") -> DataFrame:
    """df with run (from 1 by entity, in order), run_size, run_first and run_last (periods). same(a, b): whether a row goes on with the run of the row before it, from dicts of both
    rows' ``columns``; null means no. Rows of one entity have unlike periods; a null entity is one like others."""
    part = F.floor(F.col(order) / stretch)
    cell = Window.partitionBy(entity, "__part").orderBy(order)
    rows = df.withColumn("__part", part).repartition(entity, "__part")
    goes_on = F.coalesce(same({c: F.lag(c).over(cell) for c in columns}, {c: F.col(c) for c in columns}), F.lit(False)) & F.lag(order).over(cell).isNotNull()
    rows = rows.withColumn("__new", (~goes_on).cast("long")).withColumn("__run", F.sum("__new").over(cell.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    own = Window.partitionBy(entity, "__part", "__run")
    rows = rows.withColumns({"__size": F.count(F.lit(1)).over(own), "__first": F.min(order).over(own), "__last": F.max(order).over(own)})
    ends = F.struct("__size", "__first", "__last")
    short = rows.groupBy(F.col(entity).alias("__e"), F.col("__part").alias("__p")).agg(
        F.max("__run").alias("n"), F.min_by(ends, order).alias("head"), F.max_by(ends, order).alias("tail"), *(f(F.col(c), F.col(order)).alias(f"{k}_{c}") for c in columns for k, f in (("from", F.min_by), ("to", F.max_by))),
    )
    by = Window.partitionBy("__e").orderBy("__p")
    joined = F.coalesce(same({c: F.lag(f"to_{c}").over(by) for c in columns}, {c: F.col(f"from_{c}") for c in columns}), F.lit(False)) & F.lag("__p").over(by).isNotNull()
    short = short.withColumn("joined", joined.cast("long"))
    short = short.withColumn("before", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("joined").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct((F.col("before") + 1).alias("run"), F.col("head.__size").alias("size"), F.col("head.__first").alias("a"), F.col("head.__last").alias("b"))
    last = F.struct((F.col("before") + F.col("n")).alias("run"), F.col("tail.__size").alias("size"), F.col("tail.__first").alias("a"), F.col("tail.__last").alias("b"))
    outer = short.select("__e", "__p", F.explode(F.when(F.col("n") > 1, F.array(first, last)).otherwise(F.array(first))).alias("s")).select("__e", "__p", "s.*")
    whole = Window.partitionBy("__e", "run")
    outer = outer.withColumns({"size": F.sum("size").over(whole), "a": F.min("a").over(whole), "b": F.max("b").over(whole)})
    outer = outer.groupBy("__e", "__p").agg(F.min_by(F.struct("size", "a", "b"), "run").alias("head"), F.max_by(F.struct("size", "a", "b"), "run").alias("tail"))
    known = short.select("__e", "__p", "n", "before").withColumnsRenamed({"__e": "__f", "__p": "__q"})
    known = known.join(outer, F.col("__f").eqNullSafe(F.col("__e")) & (F.col("__q") == F.col("__p"))).drop("__e", "__p")
    rows = rows.join(known, rows[entity].eqNullSafe(F.col("__f")) & (F.col("__part") == F.col("__q")))
    pick = lambda x, inner: F.when(F.col("__run") == 1, F.col(f"head.{x}")).when(F.col("__run") == F.col("n"), F.col(f"tail.{x}")).otherwise(F.col(inner))
    return rows.select(*df.columns, (F.col("before") + F.col("__run")).alias("run"), pick("size", "__size").alias("run_size"), pick("a", "__first").alias("run_first"), pick("b", "__last").alias("run_last"))


def consecutive(a, b):
    """The next period follows the last one."""
    return a["period"] == b["period"] - 1


def like(*columns: str):
    """The rows have equal values in some columns."""
    return lambda a, b: reduce(lambda x, y: x & y, (a[c] == b[c] for c in columns))
