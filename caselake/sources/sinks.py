"""Writers of catalogs: JSON lines, tab-separated, Parquet, XML file objects, spreadsheet-safe CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TSV_COLUMNS = ("id", "source_path", "relative_path", "extension", "size_bytes", "sha256", "vendor", "parser", "parser_confidence")


def write_index(catalog: DataFrame, path: str) -> None:
    """One catalog as path/videos.jsonl, path/videos.tsv and path/videos.parquet (folders of parts)."""
    catalog.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/videos.jsonl")
    flat = catalog
    if "source_profile" in catalog.columns:
        flat = flat.withColumns({"vendor": F.col("source_profile.vendor"), "parser": F.col("source_profile.parser"), "parser_confidence": F.col("source_profile.confidence")})
    flat.select(*[c for c in TSV_COLUMNS if c in flat.columns]).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(f"{path}/videos.tsv")
    catalog.write.mode("overwrite").parquet(f"{path}/videos.parquet")


def xml_text(c: Column) -> Column:
    """The text with characters that XML forbids as U+FFFD."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "\ufffd")


def file_objects(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file objects, counts): filename, filesize, mtime, hashdigest of rows with a path and size; counts of written, skipped and stale rows."""
    ok = F.col("source_path").isNotNull() & F.col("size_bytes").isNotNull()
    stale = F.coalesce(F.col("stale"), F.lit(False)) if "stale" in catalog.columns else F.lit(False)
    objects = catalog.filter(ok).select(xml_text(F.col("source_path")).alias("filename"), F.col("size_bytes").alias("filesize"), F.col("modified_unix").alias("mtime"), F.lower("sha256").alias("hashdigest"))
    return objects, catalog.agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("skipped"), F.count_if(stale).alias("stale"))


def write_dfxml(catalog: DataFrame, path: str) -> DataFrame:
    """Write file objects as XML; returns the counts."""
    objects, counts = file_objects(catalog)
    objects.write.mode("overwrite").format("xml").option("rootTag", "dfxml").option("rowTag", "fileobject").save(path)
    return counts


def safe_cell(c: Column) -> Column:
    """The cell with a leading apostrophe if a spreadsheet would take it for a formula; numbers stay."""
    number = c.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    return F.when(c.rlike("^[=+\\-@\\t\\r]") & ~number, F.concat(F.lit("'"), c)).otherwise(c)


def safe_csv(df: DataFrame) -> DataFrame:
    """`df` with every text column made safe."""
    return df.withColumns({f.name: safe_cell(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, StringType)})


def write_safe_csv(df: DataFrame, path: str) -> None:
    safe_csv(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
