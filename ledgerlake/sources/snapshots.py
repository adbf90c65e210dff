"""Versions of the whole bank: the tables that a request batch changes become visible together, or not at all.

Below a root folder, ``data/<table>/part=<id>`` holds Parquet folders that never change once written, and
``manifests/<version>.json`` names the folders of each table in that version. A commit writes each changed table to new
folders, in parallel over the cluster, and last one manifest, renamed into place. A run that dies before the rename
leaves the version before it as it was; its folders are named by no manifest and never read. New rows of a log are a
folder more (``appends``), so a commit costs what it adds; ``compact`` rewrites tables of many folders.

A manifest also holds the last batch number of each writer, so a replayed batch is recognised and commits nothing. Two
writers that start from the same version cannot both win: the second gets ``VersionTaken`` and has to decide its batch
again over the new version. The root needs a file system whose rename is atomic and refuses an existing target (HDFS,
ABFS); on others, one writer at a time is safe.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlake.schema import TABLES, Bank
from ledgerlake.sources.tables import PARTITION_COLUMN, conform, write_table

MOST_FOLDERS = 32


class VersionTaken(RuntimeError):
    """Another writer has committed since the version that this commit is based on."""


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _fs(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first."""
    folder = _path(spark, root, "manifests")
    fs = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """version, tables (name to folders) and writers (name to last batch); version 0 is the empty bank."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if version == 0:
        return {"version": 0, "tables": {}, "writers": {}}
    text = spark.read.text(f"{root.rstrip('/')}/manifests/{version:012d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _publish(spark: SparkSession, root: str, found: dict) -> None:
    """Write a manifest beside its name, then rename it; an existing name means that another writer was first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = _fs(spark, root)
    draft = _path(spark, root, "manifests", f"_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(found, sort_keys=True).encode())
    out.close()
    options = getattr(hadoop, "Options$Rename")
    none = spark._sc._gateway.new_array(options, 1)
    none[0] = options.NONE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    final = fs.makeQualified(_path(spark, root, "manifests", f"{found['version']:012d}.json"))
    try:
        context.rename(fs.makeQualified(draft), final, none)
    except Exception as e:
        if fs.exists(final):
            fs.delete(draft, False)
            raise VersionTaken(f"version {found['version']} exists") from e
        raise


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame] | None = None,
           appends: Mapping[str, DataFrame] | None = None, base: int | None = None,
           batch: tuple[str, int] | None = None) -> int:
    """Write a new version and return its number: ``tables`` replace whole tables, ``appends`` add rows.

    ``base`` is the version that the rows were computed from (default: the latest). ``batch`` is (writer, number);
    numbers of a writer grow, and a number that it has committed already returns the latest version unchanged.
    """
    tables, appends = dict(tables or {}), dict(appends or {})
    if unknown := (tables.keys() | appends.keys()) - TABLES.keys():
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if twice := tables.keys() & appends.keys():
        raise ValueError(f"replaced and appended to: {sorted(twice)}")
    latest = manifest(spark, root)
    if batch and latest["writers"].get(batch[0], -1) >= batch[1]:
        return latest["version"]
    if base is not None and base != latest["version"]:
        raise VersionTaken(f"based on version {base}, but {latest['version']} exists")
    folders = {name: list(parts) for name, parts in latest["tables"].items()}
    for name, rows in [*tables.items(), *appends.items()]:
        part = f"part={uuid.uuid4().hex}"
        write_table(conform(rows, name), name, f"{root.rstrip('/')}/data/{name}/{part}")
        folders[name] = folders.get(name, []) * (name in appends) + [part]
    writers = {**latest["writers"], **({batch[0]: batch[1]} if batch else {})}
    _publish(spark, root, {"version": latest["version"] + 1, "tables": folders, "writers": writers})
    return latest["version"] + 1


def read_bank(spark: SparkSession, root: str, version: int | None = None) -> Bank:
    """A1 over one version: every table comes from the same manifest, whatever is committed meanwhile."""
    found = manifest(spark, root, version)["tables"]

    def reader(name: str):
        def load() -> DataFrame:
            schema = T.StructType(list(TABLES[name].fields))
            if name == "transacao":
                schema = T.StructType(schema.fields + [T.StructField(PARTITION_COLUMN, T.IntegerType())])
            if not found.get(name):
                return spark.createDataFrame([], schema)
            at = f"{root.rstrip('/')}/data/{name}"
            rows = spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/{p}" for p in found[name]])
            return rows.select(*schema.names)
        return load

    return Bank(**{name: reader(name) for name in TABLES})


def compact(spark: SparkSession, root: str, most: int = MOST_FOLDERS) -> int:
    """Rewrite tables of more than ``most`` folders as one, as a version of its own; returns the latest version."""
    latest = manifest(spark, root)
    many = [name for name, parts in latest["tables"].items() if len(parts) > most]
    if not many:
        return latest["version"]
    bank = read_bank(spark, root, latest["version"])
    return commit(spark, root, {name: getattr(bank, name) for name in many}, base=latest["version"])


def expire(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Delete all but the last ``keep`` versions (one at least) and the folders that only they name; returns those deleted."""
    known = versions(spark, root)
    old, kept = known[:-max(keep, 1)], known[-max(keep, 1):]
    named = lambda vs: {(t, p) for v in vs for t, parts in manifest(spark, root, v)["tables"].items() for p in parts}
    gone = named(old) - named(kept)
    fs = _fs(spark, root)
    for v in old:  # first the names, so that no reader finds a version without its folders
        fs.delete(_path(spark, root, "manifests", f"{v:012d}.json"), False)
    for table, part in sorted(gone):
        fs.delete(_path(spark, root, "data", table, part), True)
    return old
