"""Sources and sinks: partitioned corpus tables, logs, upserts, manifests."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.functions.keys import config_hash
from crossgauge.operators.relational import upsert

CORPUS = "block_id string, item_id string, lang string, origin string, src_lang string, text string, label string, label_id int, labse_sim double, flags array<string>"
RUNS = "run_id string, encoder string, split string, seed int, config_hash string, accuracy double, macro_f1 double, date string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); the machine's own only in a session of one JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/crossgauge-{os.getpid()}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that df has rows of; an empty frame leaves an empty, readable table."""
    df.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_exports(df: DataFrame, path: str, by: str, values: tuple) -> None:
    """A table <by>=<value> for every value, all written in one pass; a value without rows leaves an empty table with the columns."""
    write_partitioned(df, path, by)
    there = {r[0] for r in df.sparkSession.read.parquet(path).select(by).distinct().collect()} if values else set()  # names of partitions
    for v in values:
        if v not in there:
            df.sparkSession.createDataFrame([], df.drop(by).schema).write.mode("overwrite").parquet(f"{path}/{by}={v}")


def read_corpus(spark: SparkSession, path: str, schema: str | None = None, **partition) -> DataFrame:
    """Rows of the given partitions; the filter prunes folders before any file is opened."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    for k, v in partition.items():
        df = df.where(F.col(k) == v)
    return df


class BrokenRule(ValueError):
    """Rows break the rules of their table."""


def require(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df, if every row keeps every rule; one pass counts what breaks each. Rules are SQL conditions; a null one counts as broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in rules.items()]).first()
    if broken := {k: n for k, n in counts.asDict().items() if n}:
        raise BrokenRule(", ".join(f"{k}: {n} rows" for k, n in sorted(broken.items())))
    return df


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise BrokenRule(f"no rows: {what}")
    return df


def write_split(df: DataFrame, path: str, rules: dict[str, str], *by: str) -> None:
    """write_partitioned behind the rules."""
    write_partitioned(require(df, rules), path, *by)


def read_split(spark: SparkSession, path: str, schema: str, rules: dict[str, str], **partition) -> DataFrame:
    """read_corpus under the rules; partitions that hold nothing are an error."""
    return not_empty(require(read_corpus(spark, path, schema, **partition), rules), f"{path} {partition}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file of a folder that Spark can read."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def upsert_table(new: DataFrame, path: str, keys: list[str], *by: str) -> None:
    """Replace the rows with new's keys and keep the rest, reading and rewriting only the partitions that new touches.

    A partition column belongs to the key, or a row could move. The rewritten partitions go through a scratch table
    first: Spark can't overwrite what it still reads.
    """
    spark = new.sparkSession
    touched = new.select(*by).distinct()
    old = spark.read.parquet(path).join(touched, list(by), "left_semi")
    temp = scratch(spark, "upsert")
    upsert(old, new, keys).write.parquet(temp)
    write_partitioned(spark.read.parquet(temp), path, *by)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only CSV run log, metrics rounded to six digits."""
    doubles = {f.name: F.round(f.name, 6) for f in df.schema.fields if f.dataType.typeName() == "double"}
    df.withColumns(doubles).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str = RUNS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json_rows(spark: SparkSession, config: dict) -> DataFrame:
    """A driver-side JSON document as rows of key and JSON value."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(config.items())], "key string, value string")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents under a schema; one that doesn't fit it stops the job instead of becoming nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


_TYPES = {bool: "boolean", int: "int", float: "double", str: "string"}


def typed_config(text: Column, defaults: dict, overrides: Column | None = None) -> Column:
    """struct of the defaults' keys and `unknown`: a flat YAML text over typed defaults, under overrides (map of strings).

    Comments and quotes go; a value takes the default's type, null where it can't; keys without a default are listed.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(^|\s)#.*$", ""))), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), "^(['\"])(.*)\\1$", "$2").alias("v")))
    given = F.map_from_entries(pairs)
    if overrides is not None:
        given = F.map_from_entries(F.concat(F.filter(F.map_entries(given), lambda e: ~F.map_contains_key(overrides, e["key"])), F.map_entries(overrides)))
    fields = [F.coalesce(F.when(F.map_contains_key(given, k), F.element_at(given, k)), F.lit(str(v).lower() if isinstance(v, bool) else str(v))).try_cast(_TYPES[type(v)]).alias(k) for k, v in defaults.items()]
    unknown = F.array_sort(F.array_except(F.map_keys(given), F.array(*map(F.lit, defaults))))
    return F.struct(*fields, unknown.alias("unknown"))


def load_config(path: str, defaults: dict, **overrides) -> dict:
    """YAML or JSON configuration over typed defaults; unknown keys are refused, values take the default's type."""
    with open(path, encoding="utf8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        given = yaml.safe_load(text) or {}
    else:
        given = json.loads(text)
    given = {**given, **overrides}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")
    return {k: type(v)(given.get(k, v)) if v is not None else given.get(k) for k, v in defaults.items()}


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and SHA-256 of files, read on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def manifest(df: DataFrame, *by: str) -> DataFrame:
    """rows, origins, flagged rows and an order-free content hash of every part."""
    content = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")
    flagged = F.count_if(F.size("flags") > 0) if "flags" in df.columns else F.lit(0).cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), flagged.alias("flagged_rows"), content.alias("content"))


def verify_manifest(expected: DataFrame, actual: DataFrame, *by: str) -> DataFrame:
    """Parts that are changed, missing or unexpected."""
    e, a = (x.select(*by, F.struct("rows", "content").alias(n)) for x, n in ((expected, "e"), (actual, "a")))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "changed")
    return e.join(a, list(by), "full").withColumn("status", status).where("status IS NOT NULL").select(*by, "status")


def stamped(df: DataFrame, config: dict) -> DataFrame:
    return df.withColumn("config_hash", F.lit(config_hash(config)))


def to_markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table; reports are small, and a larger one is refused rather than cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError("too large for a report")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("—" if v is None else str(v).replace("|", "\\|") for v in r) + " |\n" for r in rows)


def stale(df: DataFrame, rendered: str) -> bool:
    return to_markdown(df) != rendered
