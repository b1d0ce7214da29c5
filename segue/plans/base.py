"""Registration of queries and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segue.functions.keys import PROFILES, SPELLED, SPELLINGS
from segue.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given and the derived tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("tracks", "track_labels", "votes", "crates", "requests", "feat"):
            return view(self.spark, self.dir, name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of ``Tables``, and the SQL with the same rows."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return register


def harmonic_sql(a: str, b: str, profile: str = "engine") -> str:
    if profile in SPELLED:
        a, b = camelot_sql(a), camelot_sql(b)
    same, relative, near, across, two, other, missing = ("NULL" if x is None else f"{x}::DOUBLE" for x in PROFILES[profile])
    gap = f"abs(TRY_CAST(regexp_extract({a}, '^[0-9]+') AS INT) - TRY_CAST(regexp_extract({b}, '^[0-9]+') AS INT))"
    n = f"least({gap}, 12 - {gap})"
    letters = f"right({a}, 1) = right({b}, 1)"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN {missing} WHEN {a} = {b} THEN {same} WHEN NOT regexp_full_match({a}, '[0-9]+[AB]') OR NOT regexp_full_match({b}, '[0-9]+[AB]') THEN {other} WHEN {n} = 0 THEN {relative} WHEN {n} = 1 AND {letters} THEN {near} WHEN {n} = 1 THEN {across} WHEN {n} = 2 AND {letters} THEN {two} ELSE {other} END)"


def camelot_sql(key: str) -> str:
    said, meant = (", ".join(f"'{x}'" for x in xs) for xs in (SPELLINGS, SPELLINGS.values()))
    return f"(MAP([{said}], [{meant}])[trim({key})])"


def keys_sql() -> str:
    return "(VALUES " + ", ".join(f"('{s}', '{c}')" for s, c in SPELLINGS.items()) + ") k(spelling, camelot)"


def knn_sql(k: int, vector: str = "feat", table: str = "feat", threshold: float | None = None) -> str:
    """A body of a CTE: seed, neighbour, sim, rank."""
    above = f" AND round(list_cosine_similarity(a.v, b.v), 6) > {threshold}" if threshold is not None else ""
    u = f"(SELECT trackid, CAST({vector} AS DOUBLE[]) AS v FROM {table} WHERE {vector} IS NOT NULL)"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, neighbour) AS rank FROM (SELECT a.trackid AS seed, b.trackid AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM {u} a JOIN {u} b ON a.trackid <> b.trackid{above})) WHERE rank <= {k}"
