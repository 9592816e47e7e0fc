"""SQL databases through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import PlanError

# The databases known, their default ports and default schemas.
DEFAULT_PORTS = {"sqlserver": 1433, "mysql": 3306, "oracle": 1521, "postgresql": 5432}
DATABASES = ("sqlserver", "mysql", "sqlite", "oracle", "postgresql")
DEFAULT_SCHEMAS = {"sqlserver": "dbo", "postgresql": "public"}

_URLS = {
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database};trustServerCertificate=true",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
}
# What each system's SQL asks for.
_QUOTES = {"sqlserver": "[]", "mysql": "``"}
_LIMITS = {
    "sqlserver": "SELECT TOP ({n}) * FROM ({query}) AS src",
    "oracle": "SELECT * FROM ({query}) src WHERE ROWNUM <= {n}",
}
_SAMPLES = {
    "sqlserver": "SELECT TOP ({n}) * FROM {table}",
    "oracle": "SELECT * FROM {table} FETCH FIRST {n} ROWS ONLY",
}
_CATALOGS = {
    "oracle": "SELECT owner AS table_schema, table_name FROM all_tables WHERE owner = '{schema}'",
    "sqlite": "SELECT NULL AS table_schema, name AS table_name FROM sqlite_master WHERE type = 'table'",
}
_INFORMATION_SCHEMA = (
    "SELECT table_schema, table_name FROM information_schema.tables "
    "WHERE table_type = 'BASE TABLE' AND table_schema = '{schema}'"
)


@dataclass(frozen=True)
class Database:
    """A connection. ``url`` replaces the address built from the other fields."""

    dbms: str = "sqlserver"
    host: str = ""
    port: int | None = None
    database: str = ""
    username: str = ""
    password: str = field(default="", repr=False)
    sqlite_path: str = ""
    schema: str = ""
    url: str = ""

    @classmethod
    def from_options(cls, options: Mapping[str, object]) -> "Database":
        text = lambda name: str(options.get(name) or "").strip()
        dbms = text("dbms").lower()
        try:
            port = int(options.get("port") or 0)
        except (TypeError, ValueError):
            port = 0
        return cls(
            dbms=dbms if dbms in DATABASES else "sqlserver",
            host=text("host"), port=port if port > 0 else None, database=text("database"),
            username=text("username"), password=str(options.get("password") or ""),
            sqlite_path=text("sqlite_path"), schema=text("schema"), url=text("url"),
        )

    def check(self) -> None:
        if self.dbms not in DATABASES:
            raise PlanError(f"unknown database kind: {self.dbms}")
        if self.url:
            return
        needed = ["sqlite_path"] if self.dbms == "sqlite" else ["host", "database", "username", "password"]
        missing = [n for n in needed if not getattr(self, n)]
        if missing:
            raise PlanError(f"database connection lacks: {', '.join(missing)}")

    def options(self) -> dict[str, str]:
        """Options of the JDBC source that say where to connect."""
        self.check()
        if self.url:
            out = {"url": self.url}
        elif self.dbms == "sqlite":
            return {"url": f"jdbc:sqlite:{self.sqlite_path}"}
        else:
            port = self.port or DEFAULT_PORTS[self.dbms]
            out = {"url": _URLS[self.dbms].format(host=self.host, port=port, database=self.database)}
        if self.username:
            out |= {"user": self.username, "password": self.password}
        return out

    def default_schema(self) -> str:
        if self.schema:
            return self.schema
        if self.dbms == "oracle":
            return self.username.upper()
        if self.dbms == "mysql":
            return self.database
        return DEFAULT_SCHEMAS.get(self.dbms, "")


def limited_query(dbms: str, query: str, rows: int | None) -> str:
    """The query with a row limit in its own text: Spark does not push LIMIT down."""
    text = query.strip().rstrip(";").strip()
    if not text:
        raise PlanError("the SQL query is empty")
    if rows is None:
        return text
    pattern = _LIMITS.get(dbms, "SELECT * FROM ({query}) AS src LIMIT {n}")
    return pattern.format(query=text, n=max(1, int(rows)))


def sample_query(dbms: str, table: str, rows: int = 1000) -> str:
    """SELECT of the first rows of ``table`` or ``schema.table``."""
    parts = [p for p in table.strip().translate(str.maketrans("", "", '[]`"')).split(".") if p]
    if not parts:
        raise PlanError("the table name is empty")
    opening, closing = _QUOTES.get(dbms, '""')
    names = parts[:1] + ([".".join(parts[1:])] if len(parts) > 1 else [])
    quoted = ".".join(f"{opening}{n}{closing}" for n in names)
    pattern = _SAMPLES.get(dbms, "SELECT * FROM {table} LIMIT {n}")
    return pattern.format(table=quoted, n=max(1, int(rows)))


def tables_query(database: Database) -> str:
    schema = database.default_schema().replace("'", "''")
    return _CATALOGS.get(database.dbms, _INFORMATION_SCHEMA).format(schema=schema)


def read_options(
    database: Database,
    query: str,
    rows: int | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 0,
) -> dict[str, str]:
    """All options of a JDBC read. With a partition column the query runs in slices,
    one connection each; rows outside the bounds stay in the outer slices."""
    text = limited_query(database.dbms, query, rows)
    out = database.options()
    if partition_column is None or rows is not None:
        return out | {"query": text}
    if bounds is None or partitions < 1:
        raise PlanError("a partitioned read needs bounds and a number of partitions")
    return out | {
        "dbtable": f"({text}) t",
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def read_sql(
    spark: SparkSession,
    database: Database,
    query: str,
    rows: int | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 0,
) -> DataFrame:
    options = read_options(database, query, rows, partition_column, bounds, partitions)
    return spark.read.format("jdbc").options(**options).load()


def list_tables(spark: SparkSession, database: Database) -> DataFrame:
    """(table_schema, table_name) of the default or given schema."""
    return read_sql(spark, database, tables_query(database)).toDF("table_schema", "table_name")
