"""Files as sources: bytes with content-addressed ids, cases, and run traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import strict
from ..functions.text import format_of

#: The size cap of a source, and how many of its first bytes tell its format.
MAX_BYTES, HEAD = 32 * 1024 * 1024, 8192
CASE = {"source_url": "string", "focus": "string", "audience": "string"}
TRACE = "elapsed_seconds double, stage string, action string, result string, details string, prompt_tokens long, completion_tokens long"


def acquired(spark: SparkSession, path: str) -> DataFrame:
    """path, source_id, format and content of files up to the cap; larger ones are never read, and are findings of ``refused``."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MAX_BYTES)
    head = F.decode(F.substring("content", 1, HEAD), "ISO-8859-1")
    return files.select("path", F.concat(F.lit("paper-"), F.sha2("content", 256)).alias("source_id"), format_of(F.regexp_replace(head, "^ï»¿", "")).alias("format"), "content")


def refused(spark: SparkSession, path: str) -> DataFrame:
    """A finding (code, path, length) for every file above the cap, which ``acquired`` doesn't read: its content isn't read here either."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > MAX_BYTES)
    return files.select(F.lit("SOURCE_TOO_LARGE").alias("code"), "path", "length")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of exactly the three keys, none blank, with the fault of those that aren't."""
    text = spark.read.text(path, wholetext=True)
    decoded, fault = strict(F.col("value"), CASE)
    rows = text.select(decoded.alias("case"), fault.alias("fault"))
    blank = F.lit(False)
    for n in CASE:
        blank = blank | (F.trim(F.col("case")[n]) == "")
    return rows.select("case.*", F.coalesce("fault", F.when(blank, "blank")).alias("fault"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace events with the file that each came from as its run."""
    return spark.read.schema(TRACE).json(path).withColumn("run", F.input_file_name())
