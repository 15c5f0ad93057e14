"""Block store: volumes as Parquet rows of dense chunks, with metadata; voxel tables to blocks and back.

``blocks(dataset, variant, param, cx, cy, cz, ox, oy, oz, sx, sy, sz, dtype, data)``; data in z, y, x order, little-endian.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types by name; never evaluated from text.
DTYPES = {"uint8": "|u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "int8": "|i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8"}
SCHEMA = "cx int, cy int, cz int, ox int, oy int, oz int, sx int, sy int, sz int, dtype string, data binary"


def to_blocks(vox: DataFrame, value: str, dtype: str, chunk: int = 128, fill: float = 0) -> DataFrame:
    """Voxels gathered into chunks; voxels without a row hold ``fill``; values that the type can't hold raise."""
    kind = np.dtype(DTYPES[dtype])

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        c = [int(k.as_py()) for k in keys]
        cube = np.full((chunk,) * 3, fill, kind)
        values = table[value].to_numpy()
        if kind.kind in "ui" and len(values) and (values.min() < np.iinfo(kind).min or values.max() > np.iinfo(kind).max):
            raise OverflowError(f"{dtype} can't hold the values")
        x, y, z = (table[a].to_numpy() - k * chunk for a, k in zip("xyz", c, strict=True))
        cube[z, y, x] = values
        row = dict(zip(("cx", "cy", "cz"), c, strict=True)) | {k: 0 for k in ("ox", "oy", "oz")} | {k: chunk for k in ("sx", "sy", "sz")}
        return pa.table({k: pa.array([v], pa.int32()) for k, v in row.items()} | {"dtype": [dtype], "data": pa.array([cube.tobytes()], pa.binary())})

    keys = [F.floor(F.col(a) / chunk).cast("int").alias(f"c{a}") for a in "xyz"]
    return vox.select("x", "y", "z", value, *keys).groupBy("cx", "cy", "cz").applyInArrow(run, SCHEMA)


def to_voxels(blocks: DataFrame, chunk: int = 128, value: str = "value", skip: float | None = None, out: str = "double") -> DataFrame:
    """One row per voxel, at ``chunk number * chunk + offset``; those equal to ``skip`` are left out."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cube = np.frombuffer(row["data"], DTYPES[row["dtype"]]).reshape(row["sz"], row["sy"], row["sx"])
                at = np.argwhere(np.ones(cube.shape, bool) if skip is None else cube != skip)
                base = [row[f"c{a}"] * chunk + row[f"o{a}"] for a in "xyz"]
                values = cube[tuple(at.T)]
                yield pa.RecordBatch.from_arrays([*[pa.array(at[:, 2 - k] + base[k], pa.int64()) for k in range(3)], pa.array(values.astype(np.float64 if out == "double" else np.int64))], names=["x", "y", "z", value])

    return blocks.select(*[c.split()[0] for c in SCHEMA.split(", ")]).mapInArrow(run, f"x long, y long, z long, {value} {out}")


def write_dataset(blocks: DataFrame, path: str, dataset: str, variant: str = "", param: float = 0.0, version: int = 0) -> None:
    """Appends blocks under a dataset, a variant and a parameter, sorted so that a box prunes files and row groups."""
    rows = blocks.withColumns({"param": F.lit(param), "version": F.lit(version)})
    rows = rows.repartitionByRange("cz", "cy", "cx").sortWithinPartitions("cz", "cy", "cx")
    rows.withColumns({"dataset": F.lit(dataset), "variant": F.lit(variant)}).write.mode("append").partitionBy("dataset", "variant").option("compression", "zstd").parquet(f"{path}/blocks")


def read_dataset(spark: SparkSession, path: str, dataset: str, variant: str = "", param: float | None = None, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None, chunk: int = 128) -> DataFrame:
    """The latest version of each block (blocks that a repeated write left under one version count once), of those that a box of voxels (ends exclusive) touches; a missing dataset raises."""
    rows = spark.read.parquet(f"{path}/blocks").where(F.col("dataset") == dataset)
    rows = rows.where(F.col("variant") == variant if variant else F.col("variant").isNull() | (F.col("variant") == ""))
    if param is not None:
        rows = rows.where(F.col("param") == param)
    if low and high:
        for a, b, e in zip("xyz", low, high, strict=True):
            rows = rows.where((F.col(f"c{a}") >= b // chunk) & (F.col(f"c{a}") <= (e - 1) // chunk))
    # versions are compared on the keys alone; payloads move only where a block has several
    keys = ["param", "cx", "cy", "cz"]
    newest = rows.groupBy(*keys).agg(F.max("version").alias("version"), F.count("*").alias("n"))
    if newest.where("n > 1").isEmpty():
        return rows
    return rows.join(newest.drop("n"), [*keys, "version"], "left_semi").dropDuplicates([*keys, "version"])


def upsert(spark: SparkSession, path: str, dataset: str, vox: DataFrame, value: str, dtype: str, version: int, variant: str = "", param: float = 0.0, chunk: int = 128) -> None:
    """Writes voxels over an existing dataset: touched blocks are merged with what they held and appended as a new version."""
    keys = [f"c{a}" for a in "xyz"]
    touched = vox.select(*[F.floor(F.col(a) / chunk).cast("int").alias(f"c{a}") for a in "xyz"]).distinct()
    old = to_voxels(read_dataset(spark, path, dataset, variant, param, chunk=chunk).join(touched, keys, "left_semi"), chunk, "__old", out="long" if dtype[0] in "ui" else "double")
    both = old.join(vox.select("x", "y", "z", F.col(value).alias("__new")), ["x", "y", "z"], "full").select("x", "y", "z", F.coalesce("__new", "__old").alias(value))
    write_dataset(to_blocks(both, value, dtype, chunk), path, dataset, variant, param, version)


def write_meta(spark: SparkSession, path: str, dataset: str, attributes: dict) -> None:
    rows = [(dataset, k, json.dumps(v)) for k, v in attributes.items()]
    spark.createDataFrame(rows, "dataset string, key string, value string").write.mode("append").parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str, dataset: str) -> dict:
    """Attributes of a dataset; a missing ``scale`` is borrowed from the first dataset that has one, else ones."""
    rows = spark.read.parquet(f"{path}/meta")
    own = {r.key: json.loads(r.value) for r in rows.where(F.col("dataset") == dataset).collect()}
    if "scale" not in own:
        other = rows.where("key = 'scale'").orderBy("dataset").first()
        own["scale"] = json.loads(other.value) if other else [1.0, 1.0, 1.0]
    return own


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Datasets, variants and parameters with their blocks."""
    return spark.read.parquet(f"{path}/blocks").groupBy("dataset", "variant", "param", "dtype").agg(F.countDistinct("cx", "cy", "cz").alias("n_blocks"))


def resliced(vox: DataFrame, order: str) -> DataFrame:
    """Axes renamed: ``xyz``, ``xzy`` or ``zyx``; each is its own inverse."""
    if order not in ("xyz", "xzy", "zyx"):
        raise ValueError(order)
    rest = [c for c in vox.columns if c not in "xyz"]
    return vox.select(*[F.col(a).alias(b) for a, b in zip(order, "xyz", strict=True)], *rest)


def copied(blocks: DataFrame, shift: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Blocks moved by whole chunks, for a copy under another name."""
    return blocks.withColumns({f"c{a}": F.col(f"c{a}") + s for a, s in zip("xyz", shift, strict=True)})


def chunk_mask(files: DataFrame, column: str = "path") -> DataFrame:
    """Distinct chunks of a raw tree, from names such as ``..._x0001_y0002_z0003.raw``."""
    number = lambda a: F.regexp_extract(column, rf"_{a}(\d+)", 1).cast("int").alias(f"c{a}")
    return files.where(F.col(column).rlike(r"_x\d+_y\d+_z\d+")).select(*map(number, "xyz")).distinct()


def read_conf(text: DataFrame, column: str = "value") -> DataFrame:
    """``(key, value)`` of the lines ``key "text";`` or ``key number;`` of a raw tree's configuration."""
    m = F.regexp_extract(column, r'^\s*([A-Za-z][\w ]*)\s+"?([^";]*)"?\s*;', 1)
    v = F.regexp_extract(column, r'^\s*([A-Za-z][\w ]*)\s+"?([^";]*)"?\s*;', 2)
    return text.select(m.alias("key"), v.alias("value")).where("key <> ''")
