"""Tables on Parquet: scans, appends, partition replacement and snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append(df: DataFrame, path: str) -> None:
    """Bulk insert."""
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Replace only the partitions of ``column`` that the rows hold."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


#: A table kept in parts has so many; a change rewrites only those that hold its keys.
PARTS = 64


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Finished versions and their manifests, latest first."""
    path, fs = _files(spark, root)
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(((int(n[8:-5]), f"{root}/{n}") for n in names if n.startswith("version-") and n.endswith(".json")), reverse=True)


def _finish(spark: SparkSession, root: str, version: int, parts: dict[str, str], keep: int) -> None:
    """Put a version's manifest beside the others; the file system refuses a second one of the same number."""
    jvm = spark.sparkContext._jvm
    _, fs = _files(spark, root)
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/draft-{version:012d}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"version": version, "parts": parts}), "utf-8"))
    out.close()
    if not fs.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{root}/version-{version:012d}.json")):
        raise FileExistsError(f"{root}: version {version}")
    _drop_old(spark, root, keep)


def _drop_old(spark: SparkSession, root: str, keep: int) -> None:
    """Remove manifests but the last ``keep``, and data that none of those names; readers of a kept version lose nothing."""
    jvm = spark.sparkContext._jvm
    path, fs = _files(spark, root)
    known = _manifests(spark, root)
    used = {p for _, m in known[:keep] for p in _parts(spark, m).values()}
    for _, manifest in known[keep:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(manifest), False)
    latest = known[0][0]
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) <= latest and not any(u.split("/")[0] == name for u in used):
            fs.delete(status.getPath(), True)


def _parts(spark: SparkSession, manifest: str) -> dict[str, str]:
    return json.loads(spark.read.text(manifest, wholetext=True).first()[0])["parts"]


def _new(spark: SparkSession, root: str, version: int) -> str:
    if any(v >= version for v, _ in _manifests(spark, root)):
        raise FileExistsError(f"{root}: version {version} or a later one is there")
    return f"{root}/v{version}"


def write_snapshot(df: DataFrame, root: str, version: int, keep: int = 3) -> None:
    """Write a new version beside the old ones, then its manifest, which never replaces another.

    A reader takes the highest manifest, so a write that stops anywhere leaves the version
    before; what it left is overwritten by the next try. A version that exists is refused.
    The last ``keep`` versions stay.
    """
    df.write.mode("overwrite").parquet(_new(df.sparkSession, root, version))
    _finish(df.sparkSession, root, version, {"all": f"v{version}"}, keep)


def part_of(column: Column) -> Column:
    """The part that a key's rows are kept in."""
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int")


def write_parts(df: DataFrame, root: str, version: int, key: Column, touched: list[int] | None = None, keep: int = 3) -> None:
    """Write a new version of which only the parts in ``touched`` are new (all if None); the others stay where they are.

    ``df`` holds all rows of these parts; a touched part without rows is gone. Safe as ``write_snapshot``.
    """
    spark = df.sparkSession
    known = _manifests(spark, root)
    parts = _parts(spark, known[0][1]) if known and touched is not None else {}
    path = _new(spark, root, version)
    df.withColumn("_part", part_of(key)).write.mode("overwrite").partitionBy("_part").parquet(path)
    folder, fs = _files(spark, path)
    made = {status.getPath().getName().partition("=")[2]: f"v{version}/{status.getPath().getName()}" for status in fs.listStatus(folder) if status.getPath().getName().startswith("_part=")}
    _finish(spark, root, version, {k: v for k, v in parts.items() if touched is None or int(k) not in touched} | made, keep)


def current_version(spark: SparkSession, root: str) -> int | None:
    """The latest finished version, or None before the first."""
    known = _manifests(spark, root)
    return known[0][0] if known else None


def read_snapshot(spark: SparkSession, root: str, only: list[int] | None = None, schema: str | None = None) -> DataFrame:
    """The table as of the current version, or the given parts of it; an empty one needs a schema."""
    parts = _parts(spark, _manifests(spark, root)[0][1])
    paths = [f"{root}/{p}" for k, p in parts.items() if only is None or k == "all" or int(k) in only]
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def save_file(df: DataFrame, folder: str) -> int:
    """Write exported files (name, content) one by one from the driver, which holds one at a time; gives their number.

    Files of one name go to folders of their own, by their ``id`` where there is one.
    """
    import os

    n, used = 0, set()
    columns = [c for c in ("id", "name", "content") if c in df.columns]
    for row in df.select(*columns).toLocalIterator():
        name = os.path.basename(row["name"])
        place = folder if name not in used else os.path.join(folder, str(row["id"] if "id" in columns else n))
        used.add(name)
        os.makedirs(place, exist_ok=True)
        with open(os.path.join(place, name), "wb") as out:
            out.write(bytes(row["content"]))
        n += 1
    return n
