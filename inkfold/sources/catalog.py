"""The index of conversions and the artifact store as Parquet tables: append, amend by allowed columns, page, look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONVERSIONS = (
    "id string, doc_id string, source string, provider string, filename string, media_type string, pages long, blocks long, tables_n long, marks long, key_values long, chars long, "
    "sha256_input string, sha256_markdown string, store_key string, status string, error string, created_at timestamp"
)
AMENDABLE = ("store_key", "status", "error")
_ID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def valid_id(c: Column) -> Column:
    return F.lower(c).rlike(_ID)


def store_key(prefix: str, at: Column, id: Column, suffix: Column | str = "md") -> Column:
    """prefix/yyyy/mm/id.suffix, in the session's time zone (keep it UTC)."""
    s = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.date_format(at, "yyyy/MM"), F.lit("/"), id, F.lit("."), s)


def put(docs: DataFrame, path: str, at: str = "created_at") -> None:
    """Artifacts (id, markdown, created_at) as a table split by year and month."""
    docs.withColumns({"yyyy": F.date_format(at, "yyyy"), "mm": F.date_format(at, "MM")}).write.mode("append").partitionBy("yyyy", "mm").parquet(path)


def insert(rows: DataFrame, path: str) -> None:
    """Appends rows to the index; unknown columns are ignored, missing ones null."""
    from pyspark.sql.types import StructType

    known = StructType.fromDDL(CONVERSIONS)
    have = set(rows.columns)
    rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in known]).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONVERSIONS).parquet(path)


def amended(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index with the changes (id and some of the allowed columns) put in; the caller writes it where it wants."""
    given = [c for c in AMENDABLE if c in changes.columns]
    ch = changes.select("id", *(F.col(c).alias(f"_{c}") for c in given))
    j = index.join(ch, "id", "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in index.columns])


def page(index: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; limit within 1..500, offset 0 or more; ids break ties."""
    return index.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(max(1, min(limit, 500)))


def status_of(error: Column) -> Column:
    """Outcome of a failed request by the kind of its error."""
    codes = {"timeout": 504, "recognition": 502, "unsupported_media_type": 415, "invalid": 400, "needs_ocr": 422, "too_large": 413}
    return F.coalesce(*(F.when(error == k, F.lit(v)) for k, v in codes.items()), F.when(error.isNull(), F.lit(200)), F.lit(500))
