"""A1-A3: load the ten bank tables under fixed schemas; conform bulk inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.schema import TABLES, Bank

# Column defaults of the bank schema (applied when an insert omits the column).
DEFAULTS: dict[str, dict[str, object]] = {
    "agencia": {"sal_total": 0.0},
    "conta": {"saldo": 0.0},
    "usuario": {"role": "client"},
}


def load_bank(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None) -> Bank:
    """A1: read ``<path>/<table>`` for each of the ten tables with its fixed schema (no inference)."""
    def reader(name: str):
        def load() -> DataFrame:
            r = spark.read.schema(TABLES[name]).format(fmt)
            if options:
                r = r.options(**options)
            return r.load(f"{path.rstrip('/')}/{name}")
        return load

    return Bank(**{name: reader(name) for name in TABLES})


def load_bank_jdbc(spark: SparkSession, url: str, user: str, password: str,
                   partitioning: dict[str, tuple[str, int, int, int]] | None = None,
                   driver: str = "com.mysql.cj.jdbc.Driver") -> Bank:
    """A2: the same tables from a relational server over JDBC.

    ``partitioning[table] = (column, lower, upper, num_partitions)`` splits a
    large table into parallel range reads (e.g. ``transacao`` on
    ``id_transacao``). The server's JDBC driver jar must be on the classpath.
    """
    names = {"titularidade_conta": "Titularidade_Conta", "telefone_cliente": "Telefone_Cliente",
             "email_cliente": "Email_Cliente"}

    def reader(name: str):
        def load() -> DataFrame:
            r = (spark.read.format("jdbc").option("url", url).option("user", user)
                 .option("password", password).option("driver", driver)
                 .option("dbtable", names.get(name, name.capitalize())))
            if partitioning and name in partitioning:
                col, lo, hi, n = partitioning[name]
                r = (r.option("partitionColumn", col).option("lowerBound", lo)
                     .option("upperBound", hi).option("numPartitions", n))
            return conform(r.load(), name)
        return load

    return Bank(**{name: reader(name) for name in TABLES})


def conform(df: DataFrame, table: str, schema: T.StructType | None = None) -> DataFrame:
    """A3: column-list insert: fill omitted columns with their default (or NULL), cast to the table types."""
    schema = schema or TABLES[table]
    defaults = DEFAULTS.get(table, {})
    lower = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        src = lower.get(f.name.lower())
        if src is not None:
            c = F.col(src).cast(f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        elif f.name in defaults:
            c = F.lit(defaults[f.name]).cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def insert_rows(base: DataFrame, rows: DataFrame, table: str) -> DataFrame:
    """Append conformed rows to a table snapshot."""
    return base.unionByName(conform(rows, table), allowMissingColumns=True)


# The transaction log at rest is partitioned by month of ``data_hora`` (yyyymm), so trailing-window
# reports prune whole months before any file is opened.
PARTITION_COLUMN = "ano_mes"


def month_key(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return (F.year(c) * 100 + F.month(c)).cast("int")


def write_table(df: DataFrame, name: str, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write one table; ``transacao`` partitioned by month and range-clustered by account inside each month.

    Ranges of (month, account) give a task one month, or neighbouring ones, so a month gets about as many files as it
    fills partitions, not one from every task; a month with most rows is cut by account.
    """
    if name != "transacao":
        df.write.mode(mode).format(fmt).save(path)
        return
    rows = df.withColumn(PARTITION_COLUMN, month_key("data_hora"))
    (rows.repartitionByRange(PARTITION_COLUMN, "num_conta").sortWithinPartitions(PARTITION_COLUMN, "num_conta", "id_transacao")
     .write.mode(mode).format(fmt).partitionBy(PARTITION_COLUMN).save(path))


def write_bank(bank: Bank, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write the ten tables under ``<path>/<table>`` (see ``write_table``; several tables as one: ``snapshots.commit``)."""
    for name in TABLES:
        write_table(getattr(bank, name), name, f"{path.rstrip('/')}/{name}", mode, fmt)


def load_written_bank(spark: SparkSession, path: str, fmt: str = "parquet") -> Bank:
    """Read a bank written by ``write_bank`` (the month partition column comes back on ``transacao``)."""
    stored = T.StructType(TABLES["transacao"].fields + [T.StructField(PARTITION_COLUMN, T.IntegerType())])

    def reader(name: str):
        def load() -> DataFrame:
            schema = stored if name == "transacao" else TABLES[name]
            return spark.read.schema(schema).format(fmt).load(f"{path.rstrip('/')}/{name}")
        return load

    return Bank(**{name: reader(name) for name in TABLES})
