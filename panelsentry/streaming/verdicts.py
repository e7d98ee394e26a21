"""An extension: the chronological engine over a stream. The engine never looks ahead, so a verdict can leave as soon as its period arrives.

The state of an entity is its series so far, one number a period. Rows that come after a later period of their entity was judged are too late and
are left out, like rows behind a watermark, and of rows that repeat a period in one batch one counts; each batch may hold any number of periods, in any order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.adaptive import RAW, raw_batch, walk_many
from ..params import Method, Params

STATE = "period array<int>, level array<double>"


def stream_verdicts(stream: DataFrame, p: Params, m: Method) -> DataFrame:
    """Raw verdicts (schema ``RAW``) of a stream of entity, period, value, in append mode."""

    def judge(key, batches, state):
        period, level = (list(x) for x in state.get) if state.exists else ([], [])
        last = period[-1] if period else None
        new = pd.concat(list(batches))
        new = new[new["value"].notna() & (True if last is None else new["period"] > last)].sort_values("period").drop_duplicates("period")
        if len(new):
            period += [int(x) for x in new["period"]]
            level += [float(x) for x in new["value"]]
            state.update((period, level))
            rows = walk_many(np.zeros(len(period), np.int64), np.array(period), np.array(level), p, m)
            out = raw_batch(pa.array([key[0]], pa.string()), rows).to_pandas()
            yield (out if last is None else out[out["period"] > last]).astype({"base_first": "Int32", "base_last": "Int32"})

    return stream.select("entity", "period", "value").groupBy("entity").applyInPandasWithState(judge, RAW, STATE, "append", "NoTimeout")


def replay(series: DataFrame, folder: str, p: Params, m: Method, files_a_batch: int = 4) -> DataFrame:
    """A stored series as a stream: one file a period, some files a batch, verdicts as Parquet under ``folder``."""
    spark: SparkSession = series.sparkSession
    source, out = f"{folder}/source", f"{folder}/verdicts"
    first, last = series.selectExpr("min(period)", "max(period)").first()
    if first is None:
        return spark.createDataFrame([], RAW)
    for a in range(int(first), int(last) + 1, files_a_batch):  # in order of arrival
        series.where(f"period BETWEEN {a} AND {a + files_a_batch - 1}").select("entity", "period", "value").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("entity string, period int, value double").option("maxFilesPerTrigger", 1).parquet(source)
    query = stream_verdicts(stream, p, m).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(RAW).parquet(out)
