"""Rule store and run log."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.plans import files
from basketry.plans.mining import mine

RUN_SCHEMA = (
    "uid string, site string, name string, algorithm string, k bigint, minconf double, "
    "delta bigint, total bigint, status string, ts timestamp"
)


def _pointer(root: str, site: str, uid: str) -> str:
    return f"{root.rstrip('/')}/_current/site={_escaped(site)}/uid={_escaped(uid)}"


def store_rules(rules: DataFrame, root: str, site: str, uid: str) -> None:
    """Keep a run's rules under (site, uid); storing again replaces them.

    The rules are written to a folder of their own, then a pointer to it is
    published in one step, so a reader gets the rules before or those after, all
    of them.  A folder is deleted when the second after it follows, which leaves
    readers of the one before their files.
    """
    spark, pointer, name = rules.sparkSession, _pointer(root, site, uid), uuid.uuid4().hex
    folder = f"{root.rstrip('/')}/_versions"
    rules.write.parquet(f"{folder}/{name}")
    before = json.loads(files.read_text(spark, pointer)) if files.exists(spark, pointer) else []
    files.publish(spark, pointer, json.dumps([name, *before[:1]]))
    for old in before[1:]:
        files.delete(spark, f"{folder}/{old}")


def get_rules(spark: SparkSession, root: str, site: str, uid: str) -> DataFrame:
    """Rules of one run; no other run's folder is listed or read."""
    pointer = _pointer(root, site, uid)
    if not files.exists(spark, pointer):
        raise LookupError(f"no rules for run {uid!r} of site {site!r}")
    name = json.loads(files.read_text(spark, pointer))[0]
    rules = spark.read.parquet(f"{root.rstrip('/')}/_versions/{name}")
    if rules.isEmpty():
        raise LookupError(f"no rules for run {uid!r} of site {site!r}")
    return rules


def _escaped(value: str) -> str:
    """A value as partition folders are named: reserved characters as % and two hex digits."""
    reserved = "\"#%'*/:=?\\{}[]^"
    named = "".join(f"%{ord(c):02X}" if c in reserved or ord(c) < 32 or ord(c) == 127 else c for c in value)
    return named or "__HIVE_DEFAULT_PARTITION__"


def log_run(spark: SparkSession, root: str, uid: str, status: str, **params) -> None:
    """Append one row to the run log: started, finished or failed, with parameters."""
    names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    row = {**params, "uid": uid, "status": status, "ts": datetime.now(timezone.utc)}
    unknown = set(row) - set(names)
    if unknown:
        raise ValueError(f"unknown run fields: {', '.join(sorted(unknown))}")
    one = spark.createDataFrame([tuple(row.get(name) for name in names)], RUN_SCHEMA)
    one.write.mode("append").parquet(root)


def _runs(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(RUN_SCHEMA).parquet(root)
    except AnalysisException:
        return spark.createDataFrame([], RUN_SCHEMA)


def run_status(spark: SparkSession, root: str, uid: str) -> str | None:
    """Latest status of a run, None if it is not known."""
    rows = _runs(spark, root).where(F.col("uid") == F.lit(uid))
    return rows.agg(F.max_by("status", "ts")).first()[0]


def train(
    baskets: DataFrame, algorithm: str, root: str, log: str, uid: str, site: str = "", name: str = "", **params
) -> DataFrame:
    """Mine, store the rules and log the run; a run id can be used only once.

    The id is claimed by creating a file that must not exist yet, beside the log:
    of callers that start one id at the same moment one runs.
    """
    spark = baskets.sparkSession
    claimed = run_status(spark, log, uid) is None and files.create(spark, f"{log.rstrip('/')}/_claims/{_escaped(uid)}", uid)
    if not claimed:
        raise ValueError(f"run {uid!r} has been started before")
    logged = {key: params[key] for key in ("k", "minconf", "delta") if key in params}
    logged.update(algorithm=algorithm, site=site, name=name)
    log_run(spark, log, uid, "started", **logged)
    try:
        rules = mine(baskets, algorithm, **params)
        store_rules(rules, root, site, uid)
    except Exception:
        log_run(spark, log, uid, "failed", **logged)
        raise
    total = rules.select("total").first()
    log_run(spark, log, uid, "finished", total=total[0] if total else None, **logged)
    return rules
