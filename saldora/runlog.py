"""Writing results with a log: what was written is counted while it is written, by Spark's observations, not by a second
scan; counts, checks and times go to an append-only table."""

from __future__ import annotations

import datetime
import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "run string, stage string, path string, started timestamp, finished timestamp, rows long, metrics map<string, double>, failed map<string, long>, error string, settings string"


def write(df: DataFrame, path: str, log: str, run: str, stage: str, checks: dict[str, Column] | None = None, metrics: dict[str, Column] | None = None, mode: str = "overwrite") -> dict:
    """Writes df as Parquet and appends a row to the log, also if the write fails (the error is raised again).

    checks: by name, a condition that every row should meet; rows that do not are counted, a null counts as not met.
    metrics: by name, an aggregate of all rows."""
    spark, begun = df.sparkSession, datetime.datetime.now()
    checks, metrics = checks or {}, metrics or {}
    seen = Observation(f"{stage}-{uuid4().hex}")
    bad = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"bad_{i}") for i, c in enumerate(checks.values())]
    more = [c.cast("double").alias(f"metric_{i}") for i, c in enumerate(metrics.values())]
    row = {"run": run, "stage": stage, "path": path, "started": begun, "rows": None, "metrics": {}, "failed": {}, "error": None, "settings": json.dumps({"partitions": spark.conf.get("spark.sql.shuffle.partitions"), "mode": mode})}
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *bad, *more).write.mode(mode).parquet(path)
        got = seen.get
        row |= {"rows": got["rows"], "failed": {n: got[f"bad_{i}"] for i, n in enumerate(checks)}, "metrics": {n: got[f"metric_{i}"] for i, n in enumerate(metrics)}}
    except Exception as e:
        row["error"] = f"{type(e).__name__}: {str(e)[:500]}"
        raise
    finally:
        row["finished"] = datetime.datetime.now()
        names = [c.split()[0] for c in LOG.replace("map<string, double>", "m").replace("map<string, long>", "m").split(", ")]
        spark.createDataFrame([tuple(row[n] for n in names)], LOG).coalesce(1).write.mode("append").parquet(log)
    return row


def read(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log)


def problems(log: DataFrame) -> DataFrame:
    """run, stage, problem, rows: failed checks, stages that wrote nothing and stages that ended with an error."""
    failed = log.select("run", "stage", F.explode("failed").alias("problem", "rows")).where("rows > 0")
    empty = log.where("rows = 0").select("run", "stage", F.lit("nothing was written").alias("problem"), F.lit(0).cast("long").alias("rows"))
    errors = log.where("error is not null").select("run", "stage", F.col("error").alias("problem"), F.lit(None).cast("long").alias("rows"))
    return failed.unionByName(empty).unionByName(errors)


def summary(log: DataFrame) -> DataFrame:
    """run, stages, rows, seconds, failed_checks of each run."""
    bad = F.aggregate(F.map_values("failed"), F.lit(0).cast("long"), lambda a, x: a + x)
    return log.groupBy("run").agg(F.count("*").alias("stages"), F.sum("rows").alias("rows"), F.sum(F.unix_millis("finished") - F.unix_millis("started")).alias("milliseconds"), F.sum(bad).alias("failed_checks"))
