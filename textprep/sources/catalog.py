"""Named tables: (name, config, split) -> DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


@dataclass(frozen=True)
class Location:
    path: str
    format: str = "parquet"
    schema: T.StructType | None = None
    split_column: str | None = None
    options: dict = field(default_factory=dict)


class Catalog:
    """Where each named dataset lies.  A location either is one split or has a split column."""

    def __init__(self) -> None:
        self._locations: dict[tuple, Location] = {}

    def register(self, name: str, path: str, config: str | None = None, split: str | None = None, **how) -> "Catalog":
        self._locations[(name, config, split)] = Location(path, **how)
        return self

    def read_table(
        self, spark: SparkSession, name: str, config: str | None = None, split: str | None = None
    ) -> DataFrame:
        exact = self._locations.get((name, config, split))
        if exact is not None:
            return self._load(spark, exact)
        whole = self._locations.get((name, config, None))
        if whole is None or whole.split_column is None:
            known = sorted(str(key) for key in self._locations)
            raise KeyError(f"no table {(name, config, split)}; registered: {known}")
        return self._load(spark, whole).where(F.col(whole.split_column) == split)

    @staticmethod
    def _load(spark: SparkSession, where: Location) -> DataFrame:
        reader = spark.read.format(where.format).options(**where.options)
        if where.schema is not None:
            reader = reader.schema(where.schema)
        return reader.load(where.path)
