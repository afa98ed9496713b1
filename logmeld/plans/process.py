"""Raw lines to events and quarantine: detect, extract, normalise, score, validate, route.

One narrow stage from the scan to the outcome. Each step adds columns the next one reads more
than once; Catalyst keeps such steps apart, so nothing is evaluated twice. Extraction is one
``CASE`` over the detected format, so a row only pays for its own parser.

The result carries observed counts of events, failed and skipped lines (``Observation`` or a
streaming progress report reads them). The optimizer does not move filters below an observation,
so filtering on the outcome never re-evaluates the steps beneath; unused columns are still pruned.
To split events from quarantine in one pass over the lines use ``sources.writers.write_outcomes``.
"""

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logmeld import vocab
from logmeld.functions.memo import remembered
from logmeld.functions.text import strip
from logmeld.operators import cef, delimited, json_object, key_value, leef, syslog
from logmeld.operators.detect import detect_format, undetected_reason
from logmeld.operators.normalize import EVENT_COLUMNS, _ingest, id_value, map_fields, normalize
from logmeld.operators.registry import Parser, checked, extraction_steps
from logmeld.operators.validate import EVENT, validate
from logmeld.session import tune, written

QUARANTINE_COLUMNS = [
    "event_id", "timestamp", "raw_event", "reason", "detected_format", "parser_attempted",
    "file_path", "line_no",
]


def drop_blank(df: DataFrame, col: str = "line") -> DataFrame:
    """L -> L without null and white-space-only lines (skipped, not failed)."""
    return df.filter(F.length(strip(F.col(col))) > 0)


def prepared(df: DataFrame) -> DataFrame:
    """L -> L with ``line`` stripped, ``raw_line`` untouched, and file and line number."""
    given = set(df.columns)
    return drop_blank(df).select(
        F.col("raw_line" if "raw_line" in given else "line").alias("raw_line"),
        strip(F.col("line")).alias("line"),
        (F.col("file_path") if "file_path" in given else F.lit("")).alias("file_path"),
        (F.col("line_no") if "line_no" in given else F.lit(None)).cast("bigint").alias("line_no"),
        *[c for c in df.columns if c not in ("raw_line", "line", "file_path", "line_no")],
    )


@remembered
def _parts() -> dict[str, Column]:
    line, fmt = F.col("line"), F.col("format")
    return {
        "parts": F.when(fmt == "CEF", cef.header_parts(line))
        .when(fmt == "LEEF", leef.header_parts(line))
        .when(fmt == "CSV", delimited.cells(line, delimited.delimiter(line))),
        "lower": F.when(~fmt.isin("CEF", "LEEF"), F.lower(line)),
    }


def with_parts(df: DataFrame) -> DataFrame:
    """Detected L -> + parts (header parts or cells of the row's own format) and lower."""
    return df.withColumns(_parts())


def _maybe_header(lower: Column) -> Column:
    """Cheap test that every header row passes: two known names somewhere in the line."""
    words = "|".join(sorted(vocab.HEADER_WORDS))
    return lower.rlike(f"(?s)(?:{words}).*?(?:{words})")


def header_candidates(lines: DataFrame, forced_parser, parsers: Sequence[Parser] = ()) -> DataFrame:
    """The rows that may be header rows of delimited files, with their cells."""
    line = F.col("line")
    likely = lines.filter(_maybe_header(F.lower(line)))
    if forced_parser is None:
        likely = likely.filter(~line.rlike(r"^(?:<|\{|CEF:|LEEF:)"))
    parted = with_parts(detect_format(likely, forced_parser, parsers=parsers))
    return parted.withColumn("parts", F.when(F.col("format") == "CSV", F.col("parts")))


def attach_headers(
    df: DataFrame, lines: DataFrame, forced_parser, headers: list[str] | str | None, parsers: Sequence[Parser] = ()
) -> DataFrame:
    """Add the ``header`` that applies to each delimited row.

    ``headers``: "auto" carries in-band headers forward within each file, a list names the cells
    of every row, None leaves the cells positional.
    """
    if headers is None:
        return df.withColumn("header", F.lit(None).cast("array<string>"))
    if headers != "auto":
        return delimited.with_headers(df, headers)
    found = written(
        delimited.header_rows(header_candidates(lines, forced_parser, parsers), "parts"), "headers"
    )
    if delimited.few_enough(found):
        return delimited.with_headers_broadcast(df, found)
    csv = F.col("format") == "CSV"
    carried = delimited.with_headers_shuffled(df.filter(csv), "parts")
    rest = df.filter(~F.coalesce(csv, F.lit(False)))
    return carried.unionByName(rest.withColumn("header", F.lit(None).cast("array<string>")))


@remembered
def _extraction(nested: bool, has_header: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    line, lower, fmt = F.col("line"), F.col("lower"), F.col("format")
    parts, doc = F.col("parts"), F.col("document")
    header = F.col("header") if has_header else F.lit(None).cast("array<string>")
    asa = key_value.is_asa(line)
    fields = {
        "fields": F.when(fmt == "CEF", cef.fields(line, parts))
        .when(fmt == "LEEF", leef.fields(parts))
        .when(fmt == "JSON", json_object.fields(doc, line if nested else None))
        .when(fmt == "KEY_VALUE", key_value.fields(line))
        .when(fmt == "SYSLOG", syslog.fields(line, F.col("shape")))
        .when(fmt == "CSV", delimited.fields(parts, header, lower)),
        "vendor": F.when(fmt == "JSON", json_object.vendor(doc, lower))
        .when(fmt == "KEY_VALUE", key_value.vendor(lower, asa))
        .when(fmt == "SYSLOG", syslog.vendor(line, lower))
        .when(fmt == "CSV", delimited.vendor(parts, lower)),
    }
    return fields, {
        "device_type": F.when(fmt == "CEF", cef.device_type(F.get(parts, F.lit(2)), F.get(parts, F.lit(5))))
        .when(fmt == "LEEF", leef.device_type(F.get(parts, F.lit(2))))
        .when(fmt == "JSON", json_object.device_type(doc, lower))
        .when(fmt == "KEY_VALUE", key_value.device_type(lower, asa))
        .when(fmt == "SYSLOG", syslog.device_type(line, lower, F.col("vendor")))
        .when(fmt == "CSV", delimited.device_type(parts, lower)),
        "error": F.when(fmt == "CEF", cef.error(line, parts))
        .when(fmt == "LEEF", leef.error(line, parts))
        .when(fmt == "JSON", json_object.error(doc)),
        "is_header": F.coalesce((fmt == "CSV") & delimited.is_header(parts), F.lit(False)),
    }


def extract_fields(df: DataFrame, nested: bool = False, parsers: Sequence[Parser] = ()) -> DataFrame:
    """Detected L with parts -> F: fields, vendor, device_type, error, is_header.

    ``nested``: members of nested JSON objects come along under dotted names.
    """
    for step in [*_extraction(nested, "header" in df.columns), *extraction_steps(checked(parsers))]:
        df = df.withColumns(step)
    return df


def process(
    lines: DataFrame,
    forced_parser: str | Column | None = None,
    ingest_ts=None,
    ref_year: int | None = None,
    headers: list[str] | str | None = "auto",
    extra_aliases: dict[str, list[str]] | None = None,
    cef_severity_scale: bool = False,
    mapping: DataFrame | Column | None = None,
    nested: bool | None = None,
    labels: dict[str, str | Column] | None = None,
    parsers: Sequence[Parser] = (),
    observation: Observation | None = None,
) -> DataFrame:
    """L -> one row per non-blank line: event columns, ``outcome``, ``reason`` and origin.

    ``nested``: members of nested JSON objects can be named, with dots; by default where an extra alias has a dot. ``labels``:
    the vendor and device_type of all lines, whatever the lines say. ``parsers``: a caller's own (``operators.registry``).
    ``observation`` gets the counts of the run that writes the rows (``writers.ingest``). ``outcome`` is ``event``, ``failed`` or ``skipped`` (header rows). Applies ``session.tune``.
    """
    tune(lines.sparkSession)
    clean = prepared(lines)
    detected = with_parts(detect_format(clean, forced_parser, parsers=parsers))
    headed = attach_headers(detected, clean, forced_parser, headers, parsers)
    if nested is None:
        nested = any("." in name for names in (extra_aliases or {}).values() for name in names)
    extracted = extract_fields(headed, nested, parsers)
    if mapping is not None:
        extracted = map_fields(extracted, mapping)
    for name, value in (labels or {}).items():
        given = value if isinstance(value, Column) else F.lit(value)
        extracted = extracted.withColumn(name, F.coalesce(given, F.col(name)))
    events = normalize(extracted, ingest_ts, ref_year, extra_aliases, cef_severity_scale, universal=mapping is not None)
    return _with_outcome(validate(events, EVENT, "invalid"), _ingest(ingest_ts), observation)


def _with_outcome(df: DataFrame, ingest: Column, observation: Observation | None = None) -> DataFrame:
    c = F.col
    undetected = undetected_reason(c("line"), c("format"), c("parser"), c("confidence"))
    failed_parse = F.concat(
        F.lit("Parser '"), c("parser"), F.lit("' extraction error: "), c("error")
    )
    failed_check = F.concat(F.lit("Validation failed: "), c("invalid"))
    staged = df.withColumn(
        "reason",
        F.coalesce(undetected, failed_parse, F.when(~c("is_header"), failed_check)),
    )
    known = c("format").isNotNull()
    rows = staged.select(
        *EVENT_COLUMNS,
        "timestamp_source",
        F.when(c("reason").isNotNull(), "failed").when(c("is_header"), "skipped")
        .otherwise("event").alias("outcome"),
        "reason",
        F.coalesce(c("format"), F.lit("unknown")).alias("detected_format"),
        F.when(known, c("parser")).alias("parser_attempted"),
        "file_path", "line_no", "raw_line",
        ingest.alias("ingested_at"),
    )
    return rows.observe(
        observation or f"outcomes-{uuid.uuid4().hex}",
        *[F.count_if(c("outcome") == o).alias(o) for o in ("event", "failed", "skipped")],
    )


def onboard_source(
    lines: DataFrame, config: DataFrame, ingest_ts=None, ref_year: int | None = None, source: str | None = None
) -> DataFrame:
    """Lines of a new source -> processed rows, by configuration alone.

    ``config``: (name, vendor, device_type, parser, field_mapping), one row per source, any number of them; ``source``
    names the row where there are several.
    """
    rows = (config if source is None else config.filter(F.col("name") == source)).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("name one configured source")
    row = rows[0]
    names = row["field_mapping"] or {}
    mapping = lines.sparkSession.createDataFrame(
        [(k, v, i) for i, (k, v) in enumerate(names.items())],
        "vendor_field string, universal_field string, priority int",
    )
    labels = {k: row[k] for k in ("vendor", "device_type") if row[k] is not None}
    return process(
        lines, forced_parser=row["parser"], ingest_ts=ingest_ts, ref_year=ref_year, mapping=mapping,
        nested=any("." in name for name in names), labels=labels)


def onboard_sources(
    lines: DataFrame, config: DataFrame, source_col: str, ingest_ts=None, ref_year: int | None = None
) -> DataFrame:
    """Lines of any number of configured sources -> processed rows, in one pass; ``source_col`` names each line's source.

    A source's configuration reaches its lines by a join, which Spark broadcasts or shuffles by the size it finds. Lines whose source is not configured
    are detected as if there were no configuration. Of several rows of one name any one counts.
    """
    config = config.dropDuplicates(["name"])
    entries = config.select("name", F.posexplode("field_mapping").alias("priority", "vendor_field", "universal_field"))
    targets = entries.groupBy("name", F.lower("vendor_field").alias("vendor_field")).agg(
        F.collect_set(F.struct("priority", "universal_field")).alias("targets"))
    maps = targets.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("vendor_field", "targets"))).alias("_mapping"))
    rows = config.join(maps, "name", "left").select(
        F.col("name").alias("_source"), F.col("vendor").alias("_label_vendor"), F.col("device_type").alias("_label_device"),
        F.col("parser").alias("_forced_by"), "_mapping")
    rows = written(rows, "sources")
    nested = bool(rows.filter(F.exists(F.map_keys("_mapping"), lambda k: k.contains("."))).limit(1).count())
    joined = lines.join(rows, F.col(source_col) == F.col("_source"), "left")
    return process(
        joined, forced_parser=F.col("_forced_by"), ingest_ts=ingest_ts, ref_year=ref_year, mapping=F.col("_mapping"), nested=nested,
        labels={"vendor": F.col("_label_vendor"), "device_type": F.col("_label_device")})


def quarantine_reason(processed: DataFrame) -> DataFrame:
    """Processed lines -> Q: one row per failed line, with the reason."""
    c = F.col
    return processed.filter(c("outcome") == "failed").select(
        id_value("fail_", c("file_path"), c("line_no"), c("raw_event")).alias("event_id"),
        c("ingested_at").alias("timestamp"),
        "raw_event", "reason", "detected_format", "parser_attempted", "file_path", "line_no",
    )


def events_of(processed: DataFrame) -> DataFrame:
    """Processed lines -> E."""
    return processed.filter(F.col("outcome") == "event").select(
        *EVENT_COLUMNS, "timestamp_source", "file_path", "line_no"
    )


def route(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Processed lines -> (E, Q)."""
    return events_of(processed), quarantine_reason(processed)
