"""Reading and writing: bronze, silver, outputs, labels and the ledger."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..params import LABELS, Params

#: Source headers and their names.
BRONZE = {
    "Financier": "financier",
    "Fiscal Year": "fiscal_year",
    "Region": "region",
    "Country / Economy": "country",
    "Gross Disbursement (US$)": "gross_disbursement_usd",
    "Repayments (US$)": "repayments_usd",
    "Net Disbursement (US$)": "net_disbursement_usd",
    "Interest (US$)": "interest_usd",
    "Fees (US$)": "fees_usd",
    "IBRD Commitments (US$)": "ibrd_commitments_usd",
    "IDA Grant Commitments (US$)": "ida_grant_commitments_usd",
    "IDA Non-Concessional Commitments (US$)": "ida_nonconcessional_commitments_usd",
    "IDA Concessional Commitments (US$)": "ida_concessional_commitments_usd",
    "IDA Other Commitments (US$)": "ida_other_commitments_usd",
}
#: Roles that the jobs use, by source column.
ROLES = {"financier": "grp", "country": "entity", "fiscal_year": "period", "gross_disbursement_usd": "gross", "repayments_usd": "repayments", "net_disbursement_usd": "net"}
LABEL_SCHEMA = "entity string, period int, robust_z double, severity string, change_pct double, rule string, currently_alerting boolean, explanation string, label string, note string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of the session's own only where that is unset and all runs on one machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as read from the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as written by columns below the shared checkpoint folder: who reads it later, also several times, reads only the columns and rows that are asked. What this has
    returned isn't written again."""
    if getattr(df, "_stored", False):
        return df
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = True
    return out


def check_columns(df: DataFrame, expected) -> None:
    """Fails on columns that are absent; others may be there."""
    absent = sorted(set(expected) - set(df.columns))
    if absent:
        raise ValueError(f"SCHEMA DRIFT: the source has no {absent}")


RESCUED = "_rescued"


def load_bronze(spark: SparkSession, path: str, kind: str = "csv", names: dict[str, str] | None = None, rescue: bool = False) -> DataFrame:
    """The source under its own names; whole-number periods, double amounts, NaN as null. A value that can't be read is null; with ``rescue`` its text stays in the map
    ``_rescued`` (by column; null where all could be read)."""
    names = BRONZE if names is None else names
    raw = spark.read.format(kind).options(**({"header": True} if kind == "csv" else {})).load(path)
    check_columns(raw, names)
    df = raw.withColumnsRenamed(names)
    money = [n for n in names.values() if n.endswith("_usd")]
    typed = {n: F.nanvl(F.expr(f"try_cast({n} as double)"), F.lit(None)) for n in money}
    typed |= {"fiscal_year": F.expr("try_cast(fiscal_year as int)")} if "fiscal_year" in names.values() else {}
    if rescue:
        failed = [F.struct(F.lit(n).alias("key"), F.when(F.expr(f"try_cast({n} as {'int' if n == 'fiscal_year' else 'double'})").isNull(), F.col(n).cast("string")).alias("value")) for n in typed]
        lost = F.filter(F.array(*failed), lambda e: e["value"].isNotNull() & (F.trim(e["value"]) != ""))
        df = df.withColumn(RESCUED, F.when(F.size(lost) > 0, F.map_from_entries(lost)))
    return df.withColumns(typed)


def observe_bronze(bronze: DataFrame, keys: tuple[str, ...] = ("financier", "country", "fiscal_year")) -> tuple[DataFrame, Observation]:
    """bronze (with ``_rescued``) and what the same scan counts while an action runs over it: n_rows, null_<key>, and rejected_<column> for each column that is parsed."""
    parsed = [n for n, t in bronze.dtypes if t in ("double", "int") and n not in ("_rescued",)]
    seen = Observation()
    count = [F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys if k in bronze.columns)]
    return bronze.observe(seen, *count, *(F.count_if(F.coalesce(F.col(RESCUED)[n].isNotNull(), F.lit(False))).alias(f"rejected_{n}") for n in parsed)), seen


def rejected_values(bronze: DataFrame) -> DataFrame:
    """column, value, n_rows: the texts that could not be read, and how often each."""
    return bronze.where(F.col(RESCUED).isNotNull()).select(F.explode(RESCUED).alias("column", "value")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def with_roles(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed to the roles that the jobs use."""
    return df.withColumnsRenamed(ROLES if roles is None else roles)


def write_silver(df: DataFrame, path: str, by: str = "grp") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def load_series(silver: DataFrame, group: str | None, p: Params, value: str = "gross", flows: list[str] | None = None) -> DataFrame:
    """Complete periods of one group (or all): entity, period, value and other flows. Null entities can't form a series and are left out."""
    some = silver.where((F.col("period") <= p.last_complete) & F.col("entity").isNotNull())
    if group is not None:
        some = some.where(F.col("grp") == group)
    return some.select("entity", F.col("period").cast("int").alias("period"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("value"), *(flows or []))


def write_outputs(tables: dict[str, DataFrame], path: str, by: dict[str, str] | None = None) -> None:
    """Each table in a folder of its own, partitioned by a column if ``by`` names one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(by[name]) if by and name in by else w).parquet(f"{path}/{name}")


def load_labels(spark: SparkSession, path: str | None, allowed=LABELS) -> DataFrame:
    """The label sheet: trimmed lower-case labels, empty notes; fails on a label that isn't allowed. No path: an empty sheet."""
    if path is None:
        return spark.createDataFrame([], LABEL_SCHEMA)
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return clean_labels(raw.withColumn("period", F.col("period").cast("int")), allowed)


def clean_labels(raw: DataFrame, allowed=LABELS) -> DataFrame:
    out = raw.withColumns({"label": F.lower(F.trim(F.coalesce("label", F.lit("")))), "note": F.coalesce("note", F.lit(""))})
    wrong = [r[0] for r in out.where((F.col("label") != "") & ~F.col("label").isin(*allowed)).select("label").distinct().limit(20).collect()]
    if wrong:
        raise ValueError(f"labels not allowed: {sorted(wrong)}")
    return out


class LedgerConflict(Exception):
    """Another writer has taken the state that this one was to become."""


def _log(spark: SparkSession, path: str):
    """The file system of a ledger, its log folder, and the states in it."""
    jvm = spark._jvm
    log = jvm.org.apache.hadoop.fs.Path(f"{path}/_log")
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    states = [int(f.getPath().getName()) for f in fs.listStatus(log) if f.getPath().getName().isdigit()] if fs.exists(log) else []
    return fs, log, states


def ledger_state(spark: SparkSession, path: str) -> int:
    """The number of the newest state; 0 without any."""
    return max(_log(spark, path)[2], default=0)


def read_ledger(spark: SparkSession, path: str, state: int | None = None) -> DataFrame:
    """The newest state of the ledger, or a given one. A state is what its entry in the log names: files that no entry names yet are not seen."""
    fs, log, states = _log(spark, path)
    state = max(states, default=0) if state is None else state
    if state not in states:
        raise FileNotFoundError(f"no state {state} of a ledger in {path}")
    entry = fs.open(spark._jvm.org.apache.hadoop.fs.Path(log, f"{state:020d}"))
    try:
        name = bytes(entry.readAllBytes()).decode()
    finally:
        entry.close()
    return spark.read.parquet(f"{path}/{name}")


def _claim(spark: SparkSession, path: str, state: int, name: str) -> bool:
    """Puts the entry of a state into the log, whole and only if there is none: by a rename that never replaces, or on a local disk by a link."""
    jvm = spark._jvm
    fs, log, _ = _log(spark, path)
    fs.mkdirs(log)
    draft, entry = jvm.org.apache.hadoop.fs.Path(log, f"_{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(log, f"{state:020d}")
    out = fs.create(draft, False)
    out.write(bytearray(name.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(entry.toUri().getPath()).toPath(), jvm.java.io.File(draft.toUri().getPath()).toPath())
            fs.delete(draft, False)
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, entry, none)
    except Exception as e:
        if "AlreadyExists" not in str(e) and not fs.exists(entry):
            raise
        fs.delete(draft, False)
        return False
    return True


def write_ledger(ledger: DataFrame, path: str, after: int | None = None) -> int:
    """A new state beside the old ones, which are never overwritten; its number. Files are written first and one entry in the log makes them the state, so a reader sees all of it or
    nothing. ``after``: the state that the rows were made from; if another one has followed it since, nothing changes and ``LedgerConflict`` is raised."""
    spark, name = ledger.sparkSession, f"data-{uuid.uuid4().hex}"
    ledger.write.parquet(f"{path}/{name}")
    while True:
        state = (ledger_state(spark, path) if after is None else after) + 1
        if _claim(spark, path, state, name):
            return state
        if after is not None:
            raise LedgerConflict(f"state {state} of {path} is taken")


def update_ledger(spark: SparkSession, path: str, change, attempts: int = 20) -> int:
    """Commits change(newest state) as the next state, again from the then newest one if another writer was faster; change gets None where there is no state. Both
    writers' changes survive. The number of the new state; files of lost attempts stay behind, unnamed."""
    for _ in range(attempts):
        state = ledger_state(spark, path)
        try:
            return write_ledger(change(read_ledger(spark, path, state) if state else None), path, after=state)
        except LedgerConflict:
            continue
    raise LedgerConflict(f"{attempts} attempts on {path} were overtaken")
