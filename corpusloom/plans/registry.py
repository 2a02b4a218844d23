"""All queries of the library and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that says the same."""

    def add(of: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = of
        if sql:
            ORACLE_SQL[name] = sql
        return of

    return add


#: A table ``crc`` of one row ``t``, the 256 steps of crc32, and the checksum of a text's UTF-8 bytes by it.
CRC_SQL = """crc AS (SELECT list(v ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(n)))"""


def crc32_sql(of: str) -> str:
    byte = f"('0x' || substr(hex(encode({of})), 2 * i - 1, 2))::BIGINT"
    bytes_ = f"list_transform(range(1, strlen({of}) + 1), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"corpusloom.plans.{module}")


MODULES = ("relational", "analytics", "retrieval", "evaluation", "graphs", "texts", "queues", "streams", "assembly", "functions")
