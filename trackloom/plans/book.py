"""Queries registered beside the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.adapters import Tables, oracle


def r6(c: str | Column) -> Column:
    """Rounded to six places; the shift settles halves alike in every engine."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6)


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}
        self.makes: dict[str, Callable[[Tables], DataFrame]] = {}

    def add(self, name: str, make: Callable[[Tables], DataFrame], sql: str | None = None, *needs: str) -> None:
        self.makes[name] = make
        self.queries[name] = lambda spark, sf: make(Tables(spark, sf))
        if sql:
            sql = sql.replace("R6(", "R6_(")
            self.sql[name] = _round(oracle(sql, *needs) if needs else sql.strip())


def _round(sql: str) -> str:
    """R6_(e) becomes round(e + 1e-9, 6)."""
    while (at := sql.find("R6_(")) >= 0:
        depth, end = 0, at + 3
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
            end += 1
        sql = f"{sql[:at]}round(({sql[at + 4:end]}) + 1e-9, 6){sql[end + 1:]}"
    return sql
