"""Readers and writers.

Parquet is the storage format for every table (partitioned by its natural
key); JSON lines and CSV are only produced where the reference hands files
to other tools or people.  Paths come from the caller; on a cluster they
must be shared storage.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# ------------------------------------------------------------------ S5, S8, S9
def write_table(df: DataFrame, path: str, partition_by: list | None = None,
                mode: str = "overwrite") -> None:
    """Parquet, optionally partitioned (e.g. by scenario or bench/split)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ------------------------------------------------------------------ S1, S10
def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header (one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Catalogue CSV with an explicit schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


# ------------------------------------------------------------------ S6, S7
MAX_DOCUMENT_ROWS = 2_000_000     # items or models in one parameter document
JSONL_CHUNK = 10000


def irt_jsonl_frame(responses: DataFrame, items: DataFrame, chunk: int = JSONL_CHUNK) -> DataFrame:
    """JSON objects {"subject_id": "<id>", "responses": {"q<pos>": 0/1}}.

    One record per model and block of ``chunk`` item positions, so no group
    grows with the number of items; with fewer items than ``chunk`` that is
    exactly one record per model, and a reader merges records by subject_id."""
    j = responses.select("model_id", "item_id", "resp").join(
        items.select("item_id", "item_pos"), "item_id")
    g = j.groupBy("model_id", F.floor(F.col("item_pos") / chunk).alias("_chunk")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col("item_pos"), F.col("resp").cast("int"))))).alias("_m"))
    keyed = F.transform_keys("_m", lambda k, v: F.concat(F.lit("q"), k.cast("string")))
    return g.select(F.col("model_id").cast("string").alias("subject_id"), keyed.alias("responses"))


def write_irt_jsonl(responses: DataFrame, items: DataFrame, path: str) -> None:
    irt_jsonl_frame(responses, items).write.mode("overwrite").json(path)


def read_irt_params(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parameter file {disc: [[..D..] per item], diff: [[..]], ability: [[..]]}
    -> item_params(item_pos, a, b) and abilities(model_pos, theta)."""
    raw = spark.read.option("multiLine", True).json(path)
    items = raw.select(F.posexplode(F.arrays_zip(F.col("disc").alias("a"), F.col("diff").alias("b")))
                       .alias("item_pos", "z")).select(
        F.col("item_pos").cast("bigint"),
        F.transform("z.a", lambda x: x.cast("double")).alias("a"),
        F.transform("z.b", lambda x: x.cast("double")).alias("b"))
    abil = raw.select(F.posexplode("ability").alias("model_pos", "theta")).select(
        F.col("model_pos").cast("int"), F.transform("theta", lambda x: x.cast("double")).alias("theta"))
    return items, abil


def write_irt_params(item_params: DataFrame, abilities: DataFrame, items: DataFrame,
                     models: DataFrame, path: str) -> None:
    """Inverse of S7: one JSON document with position-ordered parameter lists.

    Used for exchange with external IRT tools.  The document's arrays are as
    long as the item and model tables and a JSON document is written by one
    task, so the sizes are checked first; beyond the bound keep the Parquet
    parameter tables (``write_table``)."""
    n = max(item_params.count(), abilities.count())
    if n > MAX_DOCUMENT_ROWS:
        raise ValueError(f"{n} rows exceed the single-document bound {MAX_DOCUMENT_ROWS}; "
                         "write the parameter tables as Parquet instead")
    ip = item_params.join(items.select("item_id", "item_pos"), "item_id")
    ab = abilities.join(models.select("model_id", "model_pos"), "model_id")
    disc = ip.agg(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "a", "b"))),
                              lambda s: s["a"]).alias("disc"),
                  F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "a", "b"))),
                              lambda s: s["b"]).alias("diff"))
    th = ab.agg(F.transform(F.array_sort(F.collect_list(F.struct("model_pos", "theta"))),
                            lambda s: s["theta"]).alias("ability"))
    # both sides are single-row aggregates
    disc.withColumn("_k", F.lit(1)).join(th.withColumn("_k", F.lit(1)), "_k").drop("_k") \
        .coalesce(1).write.mode("overwrite").json(path)


# ------------------------------------------------------------------ S11, C4
def write_runs(df: DataFrame, root: str, keys=("bench", "split_id", "family")) -> None:
    """Results of some runs, one folder a run.  Runs that ``df`` holds replace their former results,
    all others stay (dynamic partition overwrite); an empty table changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)


def read_run_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON run catalogue bench -> split -> family -> suffix, as rows (bench, split, family, suffix)."""
    level = "map<string, map<string, map<string, string>>>"
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", level)).alias("bench", "s"))
    df = df.select("bench", F.explode("s").alias("split", "f"))
    return df.select("bench", "split", F.explode("f").alias("family", "suffix"))


def read_runs(spark: SparkSession, root: str, catalog: DataFrame) -> DataFrame:
    """S8 + S11: results of the catalogue's runs under ``root``, in one read.

    The catalogue meets the partition columns in a join, so Spark prunes the folders at run time
    (dynamic partition pruning); entries of other roots do not count, entries without results give no rows,
    an entry named twice counts once."""
    runs = catalog.where(F.col("suffix") == root).select("bench", F.col("split").alias("split_id"), "family").distinct()
    # one row a run: Spark broadcasts it from its measured size, which is what lets the scan prune
    return spark.read.parquet(root).join(runs, ["bench", "split_id", "family"])


def stage_key(**params) -> str:
    """C4: a stable hash of a stage's parameters, naming its materialised output."""
    blob = json.dumps(params, sort_keys=True, default=str)
    return hashlib.sha256(blob.encode()).hexdigest()[:16]


def cached_stage(spark: SparkSession, root: str, name: str, build, **params) -> DataFrame:
    """C4: reuse a stage's Parquet output under ``root/name/<hash>``; build and
    write it when absent.  Survives executor loss and reruns.

    A stage counts as present only with its ``_SUCCESS`` mark: it is written under a
    name of its own and renamed when complete, so a half-written one is never read.
    Errors other than an absent stage are raised, and nothing is overwritten for them.
    """
    path = f"{root}/{name}/{stage_key(**params)}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(conf)
    if not fs.exists(done):
        fresh = f"{path}.{uuid.uuid4().hex}"
        build().write.parquet(fresh)
        target = jvm.org.apache.hadoop.fs.Path(path)
        if fs.exists(target) and not fs.exists(done):
            fs.delete(target, True)  # the remains of a write that never ended
        own = jvm.org.apache.hadoop.fs.Path(fresh)
        if fs.exists(done) or not fs.rename(own, target):
            fs.delete(own, True)  # another writer was first
        if not fs.exists(done):
            raise OSError(f"could not move {fresh} to {path}")
    return spark.read.parquet(path)
