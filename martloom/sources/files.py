"""File-level jobs over tables of (file_name, content): conformance checks and manifests.

All checks of a file are expressions over its own content, so a batch of files needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.functions.names import normalize_header, normalize_headers, strip_all
from martloom.operators.unnest import unnest

BYTES_PER_MB = 1024 * 1024
# A quoted field, replaced by one mark so that its delimiters no longer count. The possessive
# quantifiers keep Java's matcher iterative on long fields.
QUOTED_BLANK = r'(^|[,\r\n])"[ \t]*"(?!")'
QUOTED_FIELD = r'(^|[,\r\n])(?:"[^"]*+")++'
MARK = "\x01"


def read_files(spark: SparkSession, path: str, log: DataFrame | None = None) -> DataFrame:
    """Whole files as rows, content of any size included, so that a manifest covers every file.

    Spark skips zero-byte files when it reads a folder. ``log``, a table with the ``file_name`` of
    every upload, brings them back: a logged name without content is an empty file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = listed.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes"), "content"
    )
    if log is None:
        return found
    size = F.coalesce("size_bytes", F.lit(0))
    return log.select("file_name").join(found, "file_name", "full").select(
        "file_name", size.alias("size_bytes"),
        F.when(size == 0, F.lit("").cast("binary")).otherwise(F.col("content")).alias("content"),
    )


def extension(file_name: Column) -> Column:
    return F.lower(F.regexp_extract(file_name, r"[^/.](\.[^./]+)$", 1))


def size_mb(size_bytes: Column) -> Column:
    return F.round(size_bytes / F.lit(BYTES_PER_MB), 4)


def _parsed(files: DataFrame) -> DataFrame:
    """Add the text, its header cells and its non-blank data rows."""
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    masked = F.regexp_replace(
        F.regexp_replace(F.col("text"), QUOTED_BLANK, "$1"), QUOTED_FIELD, f"$1{MARK}"
    )
    header = F.regexp_extract(F.col("text"), r'^((?:"[^"]*+"|[^"\r\n])*+)', 1)
    cells = F.regexp_extract_all(
        F.concat(F.lit(","), header), F.lit(r',((?:"[^"]*+")++|[^,]*)'), F.lit(1)
    )
    unquoted = F.transform(
        cells,
        lambda c: F.when(
            F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(c),
    )
    lines = F.split(F.col("masked"), r"\r\n|\n|\r")
    return (
        files.withColumn("text", text)
        .withColumn("masked", masked)
        .withColumn("headers", F.when(header == "", F.array().cast("array<string>")).otherwise(unquoted))
        .withColumn(
            "data_rows",
            F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda line: line.rlike(r"[^,\s\p{Z}]")),
        )
    )


def conformance(files: DataFrame, limit_mb: int) -> DataFrame:
    """One row per broken rule and file; ``bad_row`` is the first data row of another width than the header.

    Early rules stop later ones, as later ones need them.
    """
    name, size = F.col("file_name"), F.col("size_bytes")
    normalized = F.col("normalized")
    width = F.size("headers")
    stops = [
        ("missing_name", F.coalesce(name, F.lit("")) == ""),
        ("wrong_extension", extension(name) != ".csv"),
        ("empty_file", size == 0),
        ("file_too_large", size > limit_mb * BYTES_PER_MB),
        ("binary_content", F.contains(F.col("text"), F.lit("\x00"))),
        ("not_utf8", ~F.is_valid_utf8(F.col("content").cast("string"))),
        (
            "unreadable_csv",
            F.col("masked").rlike(rf'{MARK}[^,\r\n]|\r[^\n]|[,\r\n]"|^"'),
        ),
        ("no_header", width == 0),
    ]
    rules = [
        ("too_few_columns", width < 2),
        ("blank_header", F.exists("headers", lambda h: strip_all(h) == "")),
        ("unsafe_header", F.exists(normalized, lambda h: h == "")),
        ("duplicate_header", F.size(F.array_distinct(normalized)) != width),
        ("no_data_rows", F.size("data_rows") == 0),
        (
            "width_mismatch",
            F.exists("data_rows", lambda row: F.size(F.split(row, ",")) != width),
        ),
    ]
    stopped = F.lit(None).cast("string")
    for rule, broken in reversed(stops):
        stopped = F.when(broken, F.lit(rule)).otherwise(stopped)
    found = F.array_compact(F.array(*(F.when(broken, F.lit(rule)) for rule, broken in rules)))
    checked = _parsed(files).withColumns({"stopped": stopped, "normalized": normalize_headers("headers")})
    broken_rules = F.when(F.col("stopped").isNotNull(), F.array("stopped")).otherwise(found)
    bad = F.filter(
        F.transform("data_rows", lambda row, i: F.when(F.size(F.split(row, ",")) != width, i + 1)), lambda i: i.isNotNull()
    )
    rows = unnest(checked.withColumn("bad_row", F.get(bad, 0).cast("long")), ["file_name", "bad_row"], broken_rules, "rule")
    return rows.withColumn("bad_row", F.when(F.col("rule") == "width_mismatch", F.col("bad_row"))).withColumn(
        "error_code",
        F.when(F.col("rule") == "wrong_extension", "INVALID_FILE_TYPE")
        .when(F.col("rule") == "file_too_large", "FILE_TOO_LARGE")
        .otherwise("INVALID_CSV_FORMAT"),
    )


def manifest(files: DataFrame) -> DataFrame:
    """Size, checksum and shape of each file."""
    return _parsed(files).select(
        "file_name",
        extension(F.col("file_name")).alias("extension"),
        "size_bytes",
        size_mb(F.col("size_bytes")).alias("size_mb"),
        F.sha2(F.col("content"), 256).alias("checksum_sha256"),
        F.size("data_rows").cast("long").alias("row_count"),
        F.size("headers").cast("long").alias("column_count"),
    )


def header_names(headers: DataFrame, header: str = "header") -> DataFrame:
    return headers.withColumn("normalized", normalize_header(F.col(header)))


def header_problems(headers: DataFrame, file: str = "file_name", header: str = "header") -> DataFrame:
    """Names that collide within a file after normalisation, and names that normalise to nothing."""
    counted = header_names(headers, header).groupBy(file, "normalized").agg(F.count("*").alias("uses"))
    problem = F.when(F.col("normalized") == "", "empty").when(F.col("uses") > 1, "duplicate")
    return counted.withColumn("problem", problem).filter(F.col("problem").isNotNull())
