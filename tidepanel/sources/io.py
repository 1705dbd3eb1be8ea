"""Files in and out: raw CSV snapshots, fingerprints, the download log, sinks."""

from __future__ import annotations

import hashlib
import json
import urllib.request
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_COLUMNS = (
    "download_id download_date source_id source_name provider source_url_or_endpoint raw_file_path file_format parameters http_status content_type "
    "file_size_bytes file_hash notes"
).split()


@dataclass(frozen=True)
class Source:
    source_id: str
    name: str
    provider: str
    url: str
    label: str
    parameters: dict = field(default_factory=dict)
    enabled: bool = True


_TABLES = "https://www.ine.es/jaxiT3/files/t/es/csv_bdsc/{}.csv?nocab=1"
SOURCES = {
    s.source_id: s
    for s in (
        Source("2073", "demand", "national statistics", _TABLES.format(2073), "demand_2073", {"table": 2073}),
        Source("2070", "supply", "national statistics", _TABLES.format(2070), "supply_2070", {"table": 2070}),
    )
}
#: Catalogued but not read by any step.
DISABLED = {
    s.source_id: s
    for s in (
        Source("1995", "demand by region", "national statistics", "", "demand_region_1995", {"table": 1995}, False),
        Source("2046", "supply by region", "national statistics", "", "supply_region_2046", {"table": 2046}, False),
        Source("2060", "price index", "national statistics", "", "prices_2060", {"table": 2060}, False),
        Source("residents", "trips of residents", "national statistics", "", "residents", {}, False),
        Source("10839", "spending of visitors", "national statistics", "", "spending_10839", {"table": 10839}, False),
        Source("businesses", "tourism businesses", "national statistics", "", "businesses", {}, False),
        Source("climate", "climate", "weather service", "", "climate", {}, False),
    )
}


def validate_download(path: str | Path, least: int = 500) -> None:
    """Not too small, not a web page, and semicolon-separated in its first 4096 bytes."""
    p = Path(path)
    if p.stat().st_size < least:
        raise ValueError(f"{p}: under {least} bytes")
    with p.open("rb") as f:
        head = f.read(4096)
    text = head.decode("utf-8", "replace").lstrip("﻿ \r\n\t").lower()
    if text.startswith(("<!doctype", "<html")):
        raise ValueError(f"{p}: a web page")
    if b";" not in head:
        raise ValueError(f"{p}: no semicolon")


def download(source: Source, folder: str | Path, timeout: float = 120.0) -> Path:
    """Fetch over HTTP (or file://) through a .part file that becomes the snapshot or goes."""
    stamp = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}"
    target = Path(folder) / f"{stamp}_{source.label}.csv"
    part = target.with_suffix(".csv.part")
    request = urllib.request.Request(source.url, headers={"User-Agent": "tidepanel", "Accept": "text/csv"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer, part.open("wb") as f:
            if getattr(answer, "status", 200) not in (200, None):
                raise OSError(f"status {answer.status}")
            while block := answer.read(1 << 20):
                f.write(block)
        validate_download(part)
        part.rename(target)
    finally:
        part.unlink(missing_ok=True)
    return target


def sha256_file(path: str | Path) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def fingerprints(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file_name, length, file_hash) of files, hashed on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.sha2("content", 256).alias("file_hash"))


def latest_snapshot(spark: SparkSession, path: str, glob: str) -> str:
    """Path of the file with the greatest name, whatever its modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
    found = files.agg(F.max_by("path", F.element_at(F.split("path", "/"), -1))).first()[0]
    if found is None:
        raise FileNotFoundError(f"{path}/{glob}")
    return found


def read_raw_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Semicolon-separated with header, every column a string, empty fields as ''."""
    header = spark.read.option("sep", ";").option("encoding", encoding).option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(h.lstrip("﻿"), T.StringType()) for h in header])
    return spark.read.schema(schema).option("sep", ";").option("encoding", encoding).option("header", True).option("enforceSchema", True).csv(path).fillna("")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table that must have rows and the given columns."""
    df = spark.read.parquet(path)
    if columns and (missing := set(columns) - set(df.columns)):
        raise ValueError(f"{path}: missing {sorted(missing)}")
    if df.isEmpty():
        raise ValueError(f"{path}: no rows")
    return df


def append_log(spark: SparkSession, path: str, source: Source, file: Path, status: int = 200, content_type: str = "text/csv", notes: str = "") -> None:
    """One row of the download log, appended."""
    row = [
        str(uuid.uuid4()), datetime.now(timezone.utc).isoformat(), source.source_id, source.name, source.provider, source.url, str(file), "csv",
        json.dumps(source.parameters, sort_keys=True), str(status), content_type, str(file.stat().st_size), sha256_file(file), notes,
    ]
    spark.createDataFrame([row], ", ".join(f"{c} string" for c in LOG_COLUMNS)).coalesce(1).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in LOG_COLUMNS)).option("header", True).csv(path)


def unregistered(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """Snapshot ids of a table that no logged file hash carries."""
    return snapshots.select("source_snapshot_id").distinct().join(log.select(F.col("file_hash").alias("source_snapshot_id")), "source_snapshot_id", "left_anti")


def traced(spark: SparkSession, snapshots: DataFrame, log: DataFrame, folder: str) -> DataFrame:
    """Three checks of a table's snapshot ids: each is logged, its file is there, and the file's hash is the id."""
    ids = snapshots.select("source_snapshot_id").distinct()
    logged = log.select(F.col("file_hash").alias("source_snapshot_id"), F.element_at(F.split("raw_file_path", "/"), -1).alias("file_name")).dropDuplicates(["source_snapshot_id"])
    found = fingerprints(spark, folder, "*").select("file_name", F.col("file_hash").alias("now"))
    one = ids.join(logged, "source_snapshot_id", "left").join(found, "file_name", "left").agg(
        F.count_if(F.col("file_name").isNull()).alias("snapshot_logged"),
        F.count_if(F.col("file_name").isNotNull() & F.col("now").isNull()).alias("snapshot_file"),
        F.count_if(F.col("now") != F.col("source_snapshot_id")).alias("snapshot_hash"),
    )
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in one.columns))
    out = one.select(F.explode(rows).alias("r"))
    return out.select("r.check", F.when(F.col("r.violations") == 0, "PASS").otherwise("FAIL").alias("status"), F.lit("fail").alias("severity"), "r.violations")


def replace(spark: SparkSession, staged: str, path: str) -> None:
    """A written and checked table takes the place of the last one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(hadoop.Path(staged), target):
        raise OSError(f"{staged} can't be moved to {path}")


def write_parquet(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """Overwrite; ``single`` gives one ordered file, else a range-sorted table."""
    if order:
        df = df.coalesce(1).sortWithinPartitions(*order) if single else df.orderBy(*order)
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """Dates and timestamps as ISO text; doubles with a fixed number of decimals if asked."""
    cols = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        elif decimals is not None and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", c))
        cols.append(c.alias(f.name))
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temp views, so that ``spark.sql`` reaches every table."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
