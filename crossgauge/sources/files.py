"""Files of any size by tree hash, and folders of runs as a table.

Both read ranges or small files on the executors through pyarrow's file systems, so a path may be a mounted folder or a
store that pyarrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a leaf, and children of a node, of a file's hash tree.
CHUNK, FAN = 8 << 20, 1024


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def tree_hashes(spark: SparkSession, path: str, pattern: str = "*", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """path, length, digest of files: SHA-256 of every `chunk` bytes, then of up to `fan` digests (as hex) at a time, until one is left.

    The chunks of a file are rows that any task may read, so a file of any size is many small reads. Spark's readers
    don't list empty files; they have no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    ranges = files.select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("i", "at"))
    ranges = ranges.repartition(spark.sparkContext.defaultParallelism, "path", "i")

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            out = []
            for name, length, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                system, place = _file_system(name)
                with system.open_input_file(place) as f:
                    out.append(hashlib.sha256(f.read_at(min(chunk, length - at), at)).hexdigest())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], names=["path", "length", "i", "digest"])

    level = ranges.mapInArrow(hashed, "path string, length long, i int, digest string")
    chunks = files.agg(F.max(F.ceil(F.col("length") / chunk))).first()[0] or 1
    while True:
        parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]), "")
        level = level.groupBy("path", "length", F.floor(F.col("i") / fan).cast("int").alias("up")).agg(F.sha2(parts, 256).alias("digest")).withColumnRenamed("up", "i")
        chunks = -(-chunks // fan)
        if chunks <= 1:
            return level.select("path", "length", "digest")


class Runs(DataSource):
    """spark.read.format("runs").load(folder): a row for each run folder, named by its run id, from its metadata and its files.

    A folder is `<run id>` or `run_id=<run id>`; metadata is the first line of its first JSON file. A folder whose metadata
    is absent or broken is a row that isn't readable. Equality filters on run_id, lang and seed leave out folders by name.
    """

    @classmethod
    def name(cls) -> str:
        return "runs"

    def schema(self) -> str:
        return "run_id string, task string, lang string, seed int, config_hash string, accuracy double, files int, bytes long, readable boolean"

    def reader(self, schema: StructType) -> RunsReader:
        return RunsReader(self.options["path"], int(self.options.get("folders", 64)))


class Folders(InputPartition):
    """Some run folders, as paths."""


class RunsReader(DataSourceReader):
    def __init__(self, path: str, folders: int):
        self.path, self.folders, self.wanted = path, folders, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("run_id",), ("lang",), ("seed",)):
                self.wanted[f.attribute[0]] = f.value  # exact: the folder's name is where these columns come from
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        names = sorted(x.path for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and not x.base_name.startswith(("_", ".")))
        kept = [x for x in names if all(named(x)[k] == v for k, v in self.wanted.items())]
        return [Folders(kept[i : i + self.folders]) for i in range(0, len(kept), self.folders)]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        system, _ = _file_system(self.path)
        for folder in partition.value:
            files = sorted((x for x in system.get_file_info(fs.FileSelector(folder, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))), key=lambda x: x.path)
            meta, first = None, next((x for x in files if x.extension == "json"), None)
            if first is not None:
                with system.open_input_file(first.path) as f:
                    try:
                        meta = json.loads(f.read().split(b"\n", 1)[0])
                    except ValueError:
                        pass
            meta = meta if isinstance(meta, dict) else None
            n, own = named(folder), meta or {}
            yield n["run_id"], n["task"], n["lang"], n["seed"], own.get("config_hash"), own.get("accuracy"), len(files), sum(x.size for x in files), meta is not None


def named(folder: str) -> dict:
    """run_id, task, lang, seed of a folder's name; what the name doesn't hold is null."""
    import re

    run = folder.rstrip("/").rsplit("/", 1)[-1].removeprefix("run_id=")
    m = re.fullmatch(r"(task\d+)_([^_]+)_.*?_?seed(\d+)", run)
    return {"run_id": run, "task": m and m[1], "lang": m and m[2], "seed": m and int(m[3])}


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run folders under a path as a table; filters reach the listing.

    Spark pushes a filter into the load it stands on: a plan that needs the folders with and without it loads them twice.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Runs)
    return spark.read.format("runs").load(path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """path, keys (partition values of the folders), columns (name -> type), rows, readable of every Parquet file, from its footer alone.

    Footers are read on the executors; no data page is. Types are named as Arrow names them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path", "length")

    def read(batches):
        import re

        import pyarrow as pa
        import pyarrow.parquet as pq

        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                system, place = _file_system(name)
                keys = dict(re.findall(r"([^/=]+)=([^/]+)(?=/)", place))
                try:
                    with system.open_input_file(place) as f:
                        meta = pq.read_metadata(f)
                    schema = meta.schema.to_arrow_schema()
                    rows.append((name, list(keys.items()), [(c.name, str(c.type)) for c in schema], meta.num_rows, True))
                except (OSError, pa.ArrowInvalid):
                    rows.append((name, list(keys.items()), [], None, False))
            text = pa.map_(pa.string(), pa.string())
            kinds = (pa.string(), text, text, pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["path", "keys", "columns", "rows", "readable"])

    n = max(1, spark.sparkContext.defaultParallelism)
    return files.repartition(n, "path").mapInArrow(read, "path string, keys map<string,string>, columns map<string,string>, rows long, readable boolean")


def contract_faults(keys: list[str], columns: dict[str, str]) -> Column:
    """What a footer breaks of a contract: partition keys that its path must have, columns and their types that its schema must have, rows."""
    tests = [F.when(~F.map_contains_key("keys", k), f"no partition key {k}") for k in keys]
    for name, kind in columns.items():
        there = F.map_contains_key("columns", name)
        tests.append(F.when(~there, f"no column {name}").when(F.element_at("columns", name) != kind, F.concat(F.lit(f"column {name} is "), F.element_at("columns", name))))
    tests.append(F.when(F.col("rows") == 0, "no rows"))
    return F.when(~F.col("readable"), F.array(F.lit("not readable"))).otherwise(F.array_compact(F.array(*tests)))
