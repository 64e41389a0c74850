"""Free SQL over the library's tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass
class SqlResult:
    """Outcome of a statement. ``rows`` has one JSON document per row and stays distributed."""

    status: str
    columns: list[str] = field(default_factory=list)
    rows: DataFrame | None = None
    error: str | None = None

    def envelope(self) -> DataFrame | None:
        """Status, columns and row count in one row."""
        if self.rows is None:
            return None
        return self.rows.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(self.status).alias("status"), F.array(*[F.lit(c) for c in self.columns]).alias("columns"), "row_count"
        )


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> SqlResult:
    """Runs a statement over the given tables; a statement that fails gives an error result."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    try:
        df = spark.sql(sql)
    except PySparkException as e:
        return SqlResult("error", error=str(e))
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return SqlResult("success", df.columns, df.select(row.alias("row")))
