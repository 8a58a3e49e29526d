"""Key, hash and name expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator of the parts of a block-local id.
UNIT = "␟"


def item_id(task: int, key: Column) -> Column:
    return F.concat(F.lit(f"t{task}_"), F.substring(F.sha2(key, 256), 1, 12))


def local_item_id(task: int, block: Column, text: Column, discriminator: Column | None = None) -> Column:
    parts = [block, text] + ([discriminator] if discriminator is not None else [])
    return F.concat(F.lit(f"t{task}_"), block, F.lit("_"), F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, 12))


def hash_unit(key: Column, seed: int | str) -> Column:
    """A number in [0, 1] that depends on seed and key alone: the first 32 bits of their SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def partition_of(key: Column, seed: int, train_share: float = 0.5) -> Column:
    return F.when(hash_unit(key, seed) < train_share, "train").otherwise("eval")


def md5_bucket(modulus: int, *parts: Column) -> Column:
    """A number below modulus from the first 32 bits of the MD5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") % modulus


def run_id(task: Column, lang: Column, slug: Column, seed: Column) -> Column:
    return F.concat(F.lit("task"), task.cast("string"), F.lit("_"), lang, F.lit("_"), slug, F.lit("_seed"), seed.cast("string"))


def parse_run_id(run: Column) -> Column:
    """struct(prefix, seed) of a run id."""
    return F.struct(F.regexp_extract(run, r"^(.*)_seed\d+$", 1).alias("prefix"), F.regexp_extract(run, r"_seed(\d+)$", 1).cast("int").alias("seed"))


def split_path(path: Column) -> Column:
    """struct(block, lang) of "task_2/H/hin"."""
    parts = F.split(path, "/")
    return F.struct(F.get(parts, 1).alias("block"), F.get(parts, 2).alias("lang"))


def twin_condition(name: Column) -> Column:
    """The native twin of a translated condition, and the other way round."""
    return F.when(name.endswith("_mt"), F.regexp_replace(name, "_mt$", "")).otherwise(F.concat(name, F.lit("_mt")))


def source_family(name: Column) -> Column:
    return F.concat(F.substring_index(name, "_to_", 1), F.when(name.endswith("_mt"), "/mt").otherwise("/native"))


def config_hash(config: dict) -> str:
    """16 hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]


def fingerprint(config: dict, without: tuple[str, ...] = ("batch_size",)) -> str:
    return config_hash({k: v for k, v in config.items() if k not in without})


def config_hash_of(fields: dict[str, Column]) -> Column:
    """config_hash of every row's configuration; the order of the fields doesn't matter."""
    canonical = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(canonical, 256), 1, 16)


def fingerprint_of(fields: dict[str, Column], without: tuple[str, ...] = ("batch_size",)) -> Column:
    return config_hash_of({k: v for k, v in fields.items() if k not in without})
