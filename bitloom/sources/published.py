"""Tables of parts in which a write is seen all at once: data first, then a manifest of part and folder that names it.

Data lie in generation=<version>/part=<part>, manifests in _published/version=<version>; a manifest counts once its writer has marked
it whole. A reader takes the newest manifest and only the folders that it names, so it never lists the table and never
sees half a write; a write that is lost before its manifest leaves folders that nobody reads. Folders that none of
the last KEEP manifests names are removed, so readers of the manifest before the newest still find theirs. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP = 2
MANIFEST = "part string, folder string, current boolean, origin string"


def _glob(spark: SparkSession, pattern: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath() for s in found or []]


def _number(path, name: str) -> int:
    return int(next(p for p in path.toString().split("/") if p.startswith(f"{name}="))[len(name) + 1 :])


def versions(spark: SparkSession, table: str) -> list[int]:
    """The versions with a whole manifest, in order."""
    return sorted(_number(p, "version") for p in _glob(spark, f"{table}/_published/version=*/_SUCCESS"))


def manifest(spark: SparkSession, table: str, version: int | None = None) -> tuple[dict[str, str], str | None]:
    """(part to folder, the current part) of a version, by default the newest; nothing without one. As many rows as the table has parts."""
    known = versions(spark, table)
    if not known:
        return {}, None
    rows = spark.read.schema(MANIFEST).parquet(f"{table}/_published/version={known[-1] if version is None else version}").collect()
    return {r["part"]: r["folder"] for r in rows if r["folder"] is not None}, next((r["part"] for r in rows if r["current"]), None)


def write(rows: DataFrame, table: str, version: int, part: str) -> dict[str, str]:
    """Write rows by their column ``part`` for a version that is not published yet; gives part to folder. Again for the same version, it replaces what it wrote."""
    rows.withColumn("part", F.col(part).cast("string")).write.mode("overwrite").partitionBy("part").parquet(f"{table}/generation={version}")
    names = [p.getName() for p in _glob(rows.sparkSession, f"{table}/generation={version}/part=*")]
    unescaped = rows.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return {unescaped(n[5:]): f"generation={version}/{n}" for n in names}


def next_version(spark: SparkSession, table: str) -> int:
    return (versions(spark, table) or [-1])[-1] + 1


def was_published(spark: SparkSession, table: str, origin: str) -> bool:
    """Whether one of the manifests that are kept comes from this writing."""
    return any(not spark.read.schema(MANIFEST).parquet(f"{table}/_published/version={v}").where(F.col("origin") == origin).isEmpty() for v in versions(spark, table))


def publish(spark: SparkSession, table: str, version: int, parts: dict[str, str], current: str | None = None, origin: str | None = None) -> None:
    """Make the parts seen, and remove what is no longer named. origin: a name for this writing, by which a rerun knows that it is done."""
    rows = [(p, f, p == current, origin) for p, f in parts.items()]
    if current is not None and current not in parts:
        rows.append((current, None, True, origin))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{table}/_published/version={version}")
    retire(spark, table)


def retire(spark: SparkSession, table: str, keep: int = KEEP) -> None:
    known = versions(spark, table)
    kept = known[-keep:]
    named = {f for v in kept for f in manifest(spark, table, v)[0].values()}
    old = [p for p in _glob(spark, f"{table}/_published/version=*") if _number(p, "version") < kept[0]]
    for p in _glob(spark, f"{table}/generation=*/part=*"):
        if _number(p, "generation") <= known[-1] and f"{p.getParent().getName()}/{p.getName()}" not in named:
            old.append(p)
    for p in old:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, table: str, only: Iterable[str] | None = None) -> DataFrame | None:
    """The rows that the newest manifest names, of some parts where asked; None where it names none."""
    parts, _ = manifest(spark, table)
    folders = [f"{table}/{f}" for p, f in sorted(parts.items()) if only is None or p in only]
    return spark.read.parquet(*folders) if folders else None


# --- generations of one set of rows, of which one is current


def store_generation(rows: DataFrame, table: str, fingerprint: str) -> None:
    """Write rows as the generation of a fingerprint, in place of what it had, and make it current in the same step. Others stay as they are."""
    spark = rows.sparkSession
    version = next_version(spark, table)
    made = write(rows.withColumn("__generation", F.lit(fingerprint)), table, version, "__generation")
    publish(spark, table, version, {**manifest(spark, table)[0], **made}, fingerprint)


def switch_generation(spark: SparkSession, table: str, fingerprint: str) -> None:
    """Make a fingerprint's generation current again, as it was stored; one that has none is current without rows. Nothing is rewritten."""
    publish(spark, table, next_version(spark, table), manifest(spark, table)[0], fingerprint)


def current_generation(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of the current generation; None where it has none. Only its folder is read."""
    parts, current = manifest(spark, table)
    return spark.read.parquet(f"{table}/{parts[current]}").drop("__generation") if current in parts else None
