"""Format detection: one match and confidence per format, then the best format per line.

The best format is a single ordered ladder of conditions, highest confidence first and, at equal
confidence, in registry order. A ``CASE`` stops at the first rung that holds, so cheap tests
shield the expensive ones and no line pays for a comparison of all six detectors.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeld import vocab
from logmeld.functions.memo import remembered
from logmeld.functions.text import SPACE, occurrences, text_class
from logmeld.operators.registry import Parser, checked, detection_steps

# The shapes the detectors and parsers share.
KEY = r"(?<![a-zA-Z0-9_.\-])[a-zA-Z0-9_.\-]+"
PAIR = rf'({KEY})=(?:"[^"]*"|{text_class(",")}+)'
RFC5424 = rf"^<\d{{1,3}}>\d+(?:{SPACE}+{text_class()}+){{5}}"
RFC3164 = (
    rf"^(?:<(\d{{1,3}})>)?([A-Z][a-z]{{2}}{SPACE}+\d+{SPACE}+\d{{2}}:\d{{2}}:\d{{2}}(?:{SPACE}+\d{{4}})?)"
    rf"{SPACE}+({text_class(':')}+){SPACE}+"
)
CISCO_CODES = ["%ASA-", "%PIX-"]


# ---- conditions over a stripped line ----------------------------------------------------

def is_cef(line: Column) -> Column:
    return line.contains("CEF:0") | line.contains("CEF:1") | line.startswith("CEF:")


def is_leef(line: Column) -> Column:
    return line.contains("LEEF:1.0") | line.contains("LEEF:2.0") | line.startswith("LEEF:")


def looks_like_object(line: Column) -> Column:
    return line.startswith("{") & line.endswith("}")


def json_document(line: Column) -> Column:
    """Top-level members of a JSON object line, or null where the line is not one whole object.

    The parser ignores text after the first value, so the line is wrapped in an array closed by
    a sentinel: the sentinel is only reached when the line is exactly one value.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), line, F.lit(",0]")))
    return F.when(
        F.try_variant_get(wrapped, "$[1]", "int") == 0,
        F.try_variant_get(wrapped, "$[0]", "map<string,variant>"),
    )


def knows_log_keys(document: Column) -> Column:
    keys = F.transform(F.map_keys(document), F.lower)
    known = F.array(*[F.lit(k) for k in vocab.JSON_KNOWN_KEYS])
    return F.size(F.array_intersect(keys, known)) >= 2


def has_cisco_code(line: Column) -> Column:
    return line.contains(CISCO_CODES[0]) | line.contains(CISCO_CODES[1])


def pair_keys(line: Column) -> Column:
    """Lower-cased keys of the ``k=v`` pairs; lines with fewer than three ``=`` skip the scan."""
    keys = F.transform(F.regexp_extract_all(line, F.lit(PAIR), F.lit(1)), F.lower)
    return F.when(occurrences(line, "=") >= 3, keys)


def has_firewall_keys(keys: Column) -> Column:
    firewall = F.array(*[F.lit(k) for k in vocab.FIREWALL_KEYS])
    return (F.size(keys) >= 3) & (F.size(F.array_intersect(keys, firewall)) >= 2)


def is_rfc5424(line: Column) -> Column:
    return line.startswith("<") & line.rlike(RFC5424)


def is_rfc3164(line: Column) -> Column:
    return line.rlike(RFC3164)


def has_priority_mark(line: Column) -> Column:
    return line.startswith("<") & F.substring(line, 1, 6).contains(">")


def is_delimited(line: Column) -> Column:
    commas = occurrences(line, ",")
    most = F.greatest(commas, *[occurrences(line, d) for d in vocab.DELIMITERS[1:]])
    other = line.rlike(r"^(?:<|\{|CEF:|LEEF:)")
    prose = line.contains("=") & line.contains(" ") & (commas < 3)
    return ~other & (most >= 3) & ~prose


def is_data_like(line: Column) -> Column:
    return line.contains(".") & line.rlike(r"\d")


# ---- one detector per format: L -> L + (match, conf) ------------------------------------

def _detector(df: DataFrame, *rungs: tuple[Column, float]) -> DataFrame:
    conf = F.lit(0.0)
    for condition, value in reversed(rungs):
        conf = F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(conf)
    return df.withColumn("conf", conf).withColumn("match", F.col("conf") > 0)


def detect_cef(df: DataFrame, col: str = "line") -> DataFrame:
    return _detector(df, (is_cef(F.col(col)), 0.99))


def detect_leef(df: DataFrame, col: str = "line") -> DataFrame:
    return _detector(df, (is_leef(F.col(col)), 0.99))


def detect_json(df: DataFrame, col: str = "line") -> DataFrame:
    line = F.col(col)
    staged = df.withColumn("_document", F.when(looks_like_object(line), json_document(line)))
    doc = F.col("_document")
    return _detector(staged, (knows_log_keys(doc), 0.99), (doc.isNotNull(), 0.92)).drop("_document")


def detect_key_value(df: DataFrame, col: str = "line") -> DataFrame:
    line = F.col(col)
    staged = df.withColumn("_keys", pair_keys(line))
    keys = F.col("_keys")
    return _detector(
        staged,
        (has_cisco_code(line), 0.98),
        (has_firewall_keys(keys), 0.95),
        (F.size(keys) >= 3, 0.85),
    ).drop("_keys")


def detect_syslog(df: DataFrame, col: str = "line") -> DataFrame:
    line = F.col(col)
    return _detector(
        df, (is_rfc5424(line), 0.98), (is_rfc3164(line), 0.95), (has_priority_mark(line), 0.85)
    )


def detect_csv(df: DataFrame, col: str = "line") -> DataFrame:
    line = F.col(col)
    delimited = is_delimited(line)
    return _detector(df, (delimited & is_data_like(line), 0.85), (delimited, 0.80))


# ---- the best format --------------------------------------------------------------------

# (format, confidence) by rung, in the order the rungs are tried; 0 is "none".
RFC5424_RUNG, RFC3164_RUNG = 5, 7
_RUNGS = [
    (None, 0.0),
    ("CEF", 0.99), ("LEEF", 0.99), ("JSON", 0.99), ("KEY_VALUE", 0.98), ("SYSLOG", 0.98),
    ("KEY_VALUE", 0.95), ("SYSLOG", 0.95), ("JSON", 0.92), ("KEY_VALUE", 0.85), ("SYSLOG", 0.85),
    ("CSV", 0.85), ("CSV", 0.80),
]


def _by_rung(values: list, type_: str) -> Column:
    table = F.array(*[F.lit(v).cast(type_) for v in values])
    return F.element_at(table, F.col("_rung") + 1)


def _parser_name(fmt: Column) -> Column:
    chain = F.lit(None).cast("string")
    for name, f, _, _ in reversed(vocab.PARSERS):
        chain = F.when(fmt == f, F.lit(name)).otherwise(chain)
    return chain


def _forced_format(parser: Column) -> Column:
    chain = F.lit(None).cast("string")
    for name, f, _, _ in reversed(vocab.PARSERS):
        chain = F.when(parser == name, F.lit(f)).otherwise(chain)
    return chain


def detect_format(
    df: DataFrame, forced_parser: str | Column | None = None, col: str = "line", parsers: Sequence[Parser] = ()
) -> DataFrame:
    """L -> L + (format, parser, confidence, shape, document).

    ``forced_parser`` names a parser for every line, or is a column naming one per line (null:
    detect). A forced line has confidence 1.0; an unknown name leaves ``format`` null.
    ``document`` holds the parsed members of JSON lines and ``shape`` the rung that held (null for
    forced lines), so that extraction need not test a line again.
    """
    for step in [*_detection(forced_parser, col), *detection_steps(checked(parsers), F.col(col))]:
        df = df.withColumns(step)
    return df.drop("_first", "_keys", "_rung", "_forced", "_own")


@remembered
def _detection(forced_parser: str | Column | None, col: str) -> list[dict[str, Column]]:
    """The columns of ``detect_format``, in the order in which they read each other."""
    line = F.col(col)
    forced = F.lit(None).cast("string") if forced_parser is None else (
        F.lit(forced_parser) if isinstance(forced_parser, str) else forced_parser
    )
    first = (
        F.when(is_cef(line), 1)
        .when(is_leef(line), 2)
        .when(looks_like_object(line), 3)
        .when(has_cisco_code(line), 4)
        .when(is_rfc5424(line), 5)
        .otherwise(0)
    )
    steps = [{"_first": first}]
    wants_document = F.col("_first") == 3
    if forced_parser is not None:
        steps[0]["_forced"] = forced
        wants_document = wants_document | (F.col("_forced") == vocab.PARSER_OF["JSON"])
    steps.append({
        "document": F.when(wants_document, json_document(line)),
        "_keys": F.when(F.col("_first").isin(0, 3), pair_keys(line)),
    })
    at, doc, keys = F.col("_first"), F.col("document"), F.col("_keys")
    rung = (
        F.when(at.isin(1, 2), at)
        .when((at == 3) & knows_log_keys(doc), 3)
        .when((at == 4) | ((at == 3) & has_cisco_code(line)), 4)
        .when(at == 5, 5)
        .when(has_firewall_keys(keys), 6)
        .when(is_rfc3164(line), 7)
        .when(doc.isNotNull(), 8)
        .when(F.size(keys) >= 3, 9)
        .when(has_priority_mark(line), 10)
        .when(is_delimited(line), F.when(is_data_like(line), 11).otherwise(12))
        .otherwise(0)
    )
    steps.append({"_rung": rung})
    fmt = _by_rung([f for f, _ in _RUNGS], "string")
    parser = _by_rung([f and vocab.PARSER_OF[f] for f, _ in _RUNGS], "string")
    conf = _by_rung([c for _, c in _RUNGS], "double")
    if forced_parser is not None:
        given = F.col("_forced").isNotNull()
        fmt = F.when(given, _forced_format(F.col("_forced"))).otherwise(fmt)
        parser = F.when(given, F.col("_forced")).otherwise(parser)
        conf = F.when(given, F.lit(1.0)).otherwise(conf)
    shape = F.col("_rung")
    if forced_parser is not None:
        shape = F.when(F.col("_forced").isNull(), shape)
    return [*steps, {"format": fmt, "parser": parser, "confidence": conf, "shape": shape}]


def undetected_reason(line: Column, fmt: Column, parser: Column, confidence: Column,
                      min_conf: float = vocab.MIN_CONFIDENCE) -> Column:
    """Reason text for lines without a usable parser, else null."""
    unknown = F.concat(F.lit("Specified parser '"), parser, F.lit("' not found in registry"))
    unsuitable = F.concat(
        F.lit("No suitable parser detected (confidence="),
        F.format_string("%.2f", confidence), F.lit("; line_prefix='"), F.substring(line, 1, 60),
        F.lit("')"),
    )
    return F.when(fmt.isNull() & parser.isNotNull(), unknown).when(
        fmt.isNull() | (confidence < min_conf), unsuitable
    )


def reject_undetected(
    df: DataFrame, min_conf: float = vocab.MIN_CONFIDENCE, col: str = "line"
) -> DataFrame:
    """detected L -> L + reason (null where the line goes on)."""
    reason = undetected_reason(
        F.col(col), F.col("format"), F.col("parser"), F.col("confidence"), min_conf
    )
    return df.withColumn("reason", reason)


def parser_catalog(spark: SparkSession, parsers: Sequence[Parser] = ()) -> DataFrame:
    """The registry as a table (parser, format, vendor, device_type); labels that are expressions are null."""
    named = lambda value: value if isinstance(value, str) else None
    own = [(p.name, p.format, named(p.vendor), named(p.device_type)) for p in checked(parsers)]
    return spark.createDataFrame(
        [*vocab.PARSERS, *own], "parser string, format string, vendor string, device_type string"
    )


def detection_profile(df: DataFrame) -> DataFrame:
    """detected L -> (format, n, mean_confidence)."""
    return df.groupBy("format").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")
    )
