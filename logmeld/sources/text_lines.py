"""Raw lines from text files, text columns and file streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeld.functions.text import strip

# Everything a line break may be in pasted text.
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BROADCAST_SPLITS = 200_000


def _raw(reader, paths) -> DataFrame:
    text = reader.text(paths)
    return text.select(
        F.make_valid_utf8("value").alias("raw_line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """(raw_line, file_path, _start) of whole files -> + line_no, from 1 in each file; _start is dropped.

    A line's number is its place in its split plus the lines of the splits before it: one more pass over the text, without
    parsing, which comes to one row per split.
    """
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    splits = lines.groupBy("file_path", "_start").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n")
    )
    starts = splits.select(
        "file_path", "_start", "_first",
        F.expr(
            "coalesce(sum(_n) over (partition by file_path order by _start"
            " rows between unbounded preceding and 1 preceding), 0)"
        ).alias("_before"),
    )
    # Never more rows than files plus scan partitions: known before anything runs.
    bound = len(lines.inputFiles()) + lines.rdd.getNumPartitions()
    numbered = lines.join(
        F.broadcast(starts) if bound <= BROADCAST_SPLITS else starts, ["file_path", "_start"]
    )
    return numbered.withColumn(
        "line_no", F.col("_id") - F.col("_first") + F.col("_before") + 1
    ).drop("_id", "_first", "_before", "_start")


def read_log_lines(
    spark: SparkSession, paths: str | list[str], skip_unreadable: bool = False
) -> DataFrame:
    """Files, directories or globs -> (line, raw_line, file_path, line_no), in UTF-8.

    Splittable files are read in parallel and numbered afterwards. An unreadable file fails the
    read; with ``skip_unreadable`` the rest of it is left out, which no row tells.
    """
    skip = str(skip_unreadable).lower()
    reader = spark.read.option("ignoreCorruptFiles", skip).option("ignoreMissingFiles", skip)
    return number_lines(_raw(reader, paths)).select(
        strip(F.col("raw_line")).alias("line"), "raw_line", "file_path", "line_no"
    )


def explode_lines(df: DataFrame, text_col: str, key: str | list[str] | None = None) -> DataFrame:
    """A multi-line text column -> one row per trimmed, non-blank line, with its place.

    ``key`` names the column(s) that tell texts apart; their values become ``file_path``, so that
    ids differ and in-band headers stay within their text. Without it a text is told by its
    own hash, which equal texts share. The other columns are kept. Rows without any line give
    no rows.
    """
    columns = [key] if isinstance(key, str) else list(key or [])
    origin = F.concat_ws("/", F.lit("text"), *(
        [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns] or [F.sha2(F.col(text_col), 256)]
    ))
    kept = [c for c in df.columns if c not in (text_col, "file_path")]
    path = F.col("file_path") if "file_path" in df.columns and not columns else origin
    pieces = df.select(
        *kept, path.alias("file_path"),
        F.posexplode(F.split(F.col(text_col), _BREAKS)).alias("line_no", "raw_line"),
    )
    lines = pieces.withColumns({
        "line": strip(F.col("raw_line")), "line_no": (F.col("line_no") + 1).cast("bigint")
    })
    return lines.filter(F.col("line") != "")


def require_lines(lines: DataFrame) -> DataFrame:
    """The lines, or an error if there is none at all."""
    if lines.limit(1).count() == 0:
        raise ValueError("No log entries provided.")
    return lines


def stream_log_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream of lines.

    A stream has no row numbers: ``line_no`` is null, and ``_start``, the line's split, comes along.
    ``stream_process`` numbers the lines of each micro-batch by it.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _raw(reader, folder).select(
        strip(F.col("raw_line")).alias("line"), "raw_line", "file_path",
        F.lit(None).cast("bigint").alias("line_no"), "_start",
    )
