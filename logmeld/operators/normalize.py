"""Extracted fields to the fixed event schema.

Input F: ``fields`` (map), ``line``, ``format``, ``parser``, ``confidence``, and ``vendor`` /
``device_type`` where a parser's rule named one. The aliases are data (``vocab.ALIASES``);
callers add their own with ``extra_aliases``. Work is staged in three projections, so that each
picked value is computed once and read by everything after it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeld import vocab
from logmeld.functions.entries import entry, last_wins
from logmeld.functions.memo import remembered
from logmeld.functions.network import IP_PATTERN, is_ip
from logmeld.functions.text import WHITESPACE, has_any, let, non_blank, strip
from logmeld.functions.timestamps import parse_timestamp
from logmeld.operators import threat

FIELDS = "fields"


# ---- looking fields up ------------------------------------------------------------------
#
# Lookups are written as SQL text: a hundred of them are then a few parsed expressions instead of
# thousands of calls from Python to the JVM. In a test ``{v}`` stands for the value and ``{s}`` for
# the value stripped.

def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_STRIPPED = "btrim({}, '" + "".join(rf"\u{ord(ch):04x}" for ch in WHITESPACE) + "')"


def _test(test: str, value: str) -> str:
    return test.format(v=value, s=_STRIPPED.format(value))


def from_map(test: str, names: list[str]) -> Column:
    """The first value that passes the test, straight from the fields map."""
    values = [f"{FIELDS}[{_quoted(n)}]" for n in names]
    arms = [f"case when {_test(test, v)} then {v} end" for v in values]
    return F.expr(f"coalesce({', '.join(arms)})")


# ---- one value out of many aliases ------------------------------------------------------

def _filled(names: list[str]) -> Column:
    """First value that is not the empty text, untrimmed."""
    return from_map("{v} != ''", names)


def alias_value(names: list[str]) -> Column:
    return strip(from_map("{s} != ''", names))


def ip_value(names: list[str]) -> Column:
    pattern = IP_PATTERN.replace("{", "{{").replace("}", "}}")
    return strip(from_map(f"{{s}} rlike r'{pattern}'", names))


def port_value(names: list[str]) -> Column:
    return from_map("try_cast({v} as int) between 0 and 65535", names).try_cast("int")


def long_value(names: list[str]) -> Column:
    return _filled(names).try_cast("bigint")


def first_alias(df: DataFrame, aliases: list[str], out: str) -> DataFrame:
    """F -> F + the first non-blank value over the aliases, trimmed."""
    return df.withColumn(out, alias_value(aliases))


def pick_ip(df: DataFrame, aliases: list[str], out: str) -> DataFrame:
    """F -> F + the first value that is an address; others are passed over."""
    return df.withColumn(out, ip_value(aliases))


def pick_port(df: DataFrame, aliases: list[str], out: str) -> DataFrame:
    return df.withColumn(out, port_value(aliases))


def safe_long(df: DataFrame, aliases: list[str], out: str) -> DataFrame:
    return df.withColumn(out, long_value(aliases))


def valid_ip(df: DataFrame, col: str, out: str = "is_valid_ip") -> DataFrame:
    return df.withColumn(out, is_ip(F.col(col)))


# ---- label maps -------------------------------------------------------------------------

def protocol_label(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.PROTOCOL_NUMBERS.items() for x in kv])
    return F.coalesce(table[raw], F.upper(raw))


def _word_label(word: Column, groups: dict[str, list[str]], otherwise: Column) -> Column:
    chain = otherwise
    for label, words in reversed(groups.items()):
        chain = F.when(word.isin(words), F.lit(label)).otherwise(chain)
    return chain


def action_label(raw: Column) -> Column:
    word = F.lower(raw)
    return F.coalesce(_word_label(word, vocab.ACTION_WORDS, word), F.lit("unknown"))


def _numeric_severity(code: Column) -> Column:
    return (
        F.when(code.isin(0, 1), "critical")
        .when(code.isin(2, 3), "high")
        .when(code == 4, "medium")
        .when(code == 5, "low")
        .otherwise("informational")
    )


def _cef_severity(code: Column) -> Column:
    return (
        F.when(code >= 9, "critical").when(code >= 7, "high").when(code >= 4, "medium")
        .otherwise("low")
    )


def severity_label(raw: Column, cef_scale: Column | None = None) -> Column:
    """Digits on the syslog scale, words by table. ``cef_scale``: rows read on the 0-10 scale."""
    word = F.lower(strip(raw))
    words = _word_label(
        word, vocab.SEVERITY_WORDS,
        F.when(word.contains("alert"), "medium").otherwise("informational"),
    )
    code = word.try_cast("int")
    digits = _numeric_severity(code)
    if cef_scale is not None:
        digits = F.when(cef_scale, _cef_severity(code)).otherwise(digits)
    return F.when(raw.isNull(), "informational").when(word.rlike(r"^\d+$"), digits).otherwise(words)


def category_label(raw: Column, action: Column, message: Column) -> Column:
    """Explicit words, then the action, then words of the message, else network."""
    explicit = F.lower(raw)
    chain = F.when(F.lit(False), F.lit(""))
    for label, words in vocab.CATEGORY_WORDS.items():
        chain = chain.when(has_any(explicit, *words), label)
    for label, words in vocab.CATEGORY_ACTIONS.items():
        chain = chain.when(action.isin(words), label)
    return chain.when(
        has_any(F.lower(message), *vocab.CATEGORY_MESSAGE_WORDS), "authentication"
    ).otherwise("network")


def normalize_protocol(df: DataFrame, col: str, out: str = "protocol") -> DataFrame:
    return df.withColumn(out, protocol_label(F.col(col)))


def normalize_action(df: DataFrame, col: str, out: str = "action") -> DataFrame:
    return df.withColumn(out, action_label(non_blank(F.col(col))))


def normalize_severity(df: DataFrame, col: str, out: str = "severity") -> DataFrame:
    return df.withColumn(out, severity_label(F.col(col)))


def _ingest(ingest_ts) -> Column:
    if ingest_ts is None:
        return F.current_timestamp()
    return ingest_ts if isinstance(ingest_ts, Column) else F.lit(str(ingest_ts)).cast("timestamp")


def _year(ref_year, ingest: Column) -> Column:
    return F.year(ingest) if ref_year is None else F.lit(ref_year)


def normalize_timestamp(
    df: DataFrame, col: str, ref_year: int | None = None, ingest_ts=None, out: str = "timestamp"
) -> DataFrame:
    """Text -> timestamp in UTC, the ingest time where it cannot be read, and which it was."""
    ingest = _ingest(ingest_ts)
    staged = df.withColumn("_read", parse_timestamp(F.col(col), _year(ref_year, ingest)))
    read = F.col("_read")
    return staged.withColumns({
        out: F.coalesce(read, ingest),
        f"{out}_source": F.when(read.isNotNull(), "event").otherwise("ingest"),
    }).drop("_read")


def classify_category(df: DataFrame, action: str = "action", out: str = "category") -> DataFrame:
    return df.withColumn(
        out,
        category_label(
            _filled(vocab.ALIASES["category"]), F.col(action), _filled(vocab.ALIASES["message"])
        ),
    )


# ---- contexts ---------------------------------------------------------------------------

def _source_struct() -> Column:
    return F.struct(
        F.col("_vendor").alias("vendor"), F.col("_device").alias("device_type"),
        F.col("_hostname").alias("hostname"), F.col("_device_ip").alias("ip"),
    )


def _user_struct(name: Column, source: Column, destination: Column) -> Column:
    known = name.isNotNull()
    return F.struct(
        name.alias("name"), F.when(known, source).alias("source_user"),
        F.when(known, destination).alias("destination_user"),
    )


def _process_struct(name: Column, pid: Column) -> Column:
    return F.struct(name.alias("name"), pid.alias("pid"))


def _with_default(given: Column, key: str, default: str) -> Column:
    """A rule's label, else the field as it stands, else the default if there is no such field."""
    f = F.col(FIELDS)
    return F.coalesce(
        given, F.when(F.map_contains_key(f, key), f[key]).otherwise(F.lit(default))
    )


def _identity(columns, aliases: dict[str, list[str]]) -> dict[str, Column]:
    rule = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    return {
        "_vendor": _with_default(rule("vendor"), "vendor", "Generic"),
        "_device": _with_default(rule("device_type"), "device_type", "network_device"),
        "_hostname": alias_value(aliases["hostname"]),
        "_device_ip": _filled(aliases["device_ip"]),
    }


def _user_parts(aliases: dict[str, list[str]]) -> tuple[Column, Column, Column]:
    return (
        alias_value(aliases["user"]),
        strip(_filled(aliases["source_user"])),
        strip(_filled(aliases["destination_user"])),
    )


def _process_parts(aliases: dict[str, list[str]]) -> tuple[Column, Column]:
    pid = F.nullif(non_blank(_filled(aliases["pid"])), F.lit("-"))
    return strip(_filled(aliases["process"])), pid


def source_identity(df: DataFrame) -> DataFrame:
    """F -> F + source (vendor, device_type, hostname, ip)."""
    staged = df.withColumns(_identity(df.columns, vocab.ALIASES))
    return staged.withColumn("source", _source_struct()).drop(
        "_vendor", "_device", "_hostname", "_device_ip"
    )


def user_context(df: DataFrame) -> DataFrame:
    return df.withColumn("user", _user_struct(*_user_parts(vocab.ALIASES)))


def process_context(df: DataFrame) -> DataFrame:
    return df.withColumn("process", _process_struct(*_process_parts(vocab.ALIASES)))


def event_type(df: DataFrame, out: str = "event_type") -> DataFrame:
    return df.withColumn(
        out, F.coalesce(_filled(vocab.ALIASES["event_type"]), F.lit("connection"))
    )


def tags_value(fmt: Column, device: Column, detected: Column, kind: Column, category: Column) -> Column:
    return F.array_compact(F.array(
        F.lower(fmt), device, F.when(detected, F.lit("threat")), F.lower(kind),
        F.when(category != "network", category),
    ))


def event_tags(df: DataFrame, out: str = "tags") -> DataFrame:
    """Columns format, device_type, threat_detected, threat_type, category -> + tags."""
    c = F.col
    return df.withColumn(out, tags_value(
        c("format"), c("device_type"), c("threat_detected"), c("threat_type"), c("category")))


def _metadata_struct(tags: Column, processed_at: Column) -> Column:
    return F.struct(
        F.lit(vocab.SCHEMA_VERSION).alias("schema_version"),
        F.col("parser"),
        F.col("format").alias("source_format"),
        F.round("confidence", 2).alias("confidence"),
        processed_at.alias("processed_at"),
        F.lit(None).cast("double").alias("processing_time_ms"),
        tags.alias("tags"),
    )


def event_metadata(df: DataFrame, processed_at=None, tags: str = "tags") -> DataFrame:
    """Columns parser, format, confidence and tags -> + metadata."""
    return df.withColumn("metadata", _metadata_struct(F.col(tags), _ingest(processed_at)))


def id_value(prefix: str, *parts: Column) -> Column:
    """Deterministic id: the same line of the same file has the same id in every run.

    128 bits of the hash are kept. The 48 bits of a 12-digit id would collide from some tens of
    millions of rows on, and the upsert by id would then lose events.
    """
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 32))


def with_event_id(df: DataFrame, out: str = "event_id") -> DataFrame:
    return df.withColumn(
        out, id_value("evt_", F.col("file_path"), F.col("line_no"), F.col("line"))
    )


# ---- field mappings as data -------------------------------------------------------------

def map_fields(df: DataFrame, mapping: DataFrame | Column) -> DataFrame:
    """F -> F with vendor field names translated to universal ones.

    ``mapping``: (vendor_field, universal_field, priority). It is a configuration table and becomes a single map, looked up per
    row without a join; rows that bring mappings of their own have them as a column (lower-case name -> targets; null: none). Names are compared without regard to case; one vendor field may go to several universal ones. Of several
    vendor fields for one universal field the first non-blank by priority wins; names without a mapping stay. Other
    fields never lose to a translated one of the same name.
    """
    if isinstance(mapping, Column):
        table = mapping
    else:
        targets = mapping.groupBy(F.lower("vendor_field").alias("vendor_field")).agg(
            F.collect_set(F.struct("priority", "universal_field")).alias("targets"))
        table = targets.agg(F.map_from_entries(F.collect_list(F.struct("vendor_field", "targets"))).alias("m")).scalar()

    def translate(m):
        named = F.flatten(F.transform(
            F.map_entries(F.col(FIELDS)),
            lambda e: F.coalesce(
                F.transform(m[F.lower(e["key"])], lambda t: F.struct(
                    t["priority"].alias("priority"), t["universal_field"].alias("key"), e["value"].alias("value"))),
                F.array(F.struct(F.lit(-1).alias("priority"), e["key"].alias("key"), e["value"].alias("value"))),
            ),
        ))
        # Highest priority number first, so that the last of each name is the best one.
        usable = F.filter(named, lambda e: (e["priority"] < 0) | (strip(e["value"]) != ""))
        ordered = F.reverse(F.array_sort(usable))
        return last_wins(F.transform(ordered, lambda e: entry(e["key"], e["value"])))

    # The subquery gets a column of its own: it may not stand inside the lambdas.
    return (
        df.withColumn("_mapping", table)
        .withColumn(FIELDS, let(F.col("_mapping"), translate))
        .drop("_mapping")
    )


def universal_aliases(aliases: dict[str, list[str]]) -> dict[str, list[str]]:
    """Aliases with each target's own name first: what a field mapping translates to."""
    return {target: [target, *[n for n in names if n != target]] for target, names in aliases.items()}


# ---- the whole record -------------------------------------------------------------------

EVENT_COLUMNS = [
    "event_id", "timestamp", "source", "event", "network", "threat_intel", "user", "process",
    "metadata", "raw_event",
]


def _merged(extra: dict[str, list[str]] | None) -> dict[str, list[str]]:
    merged = dict(vocab.ALIASES)
    for target, names in (extra or {}).items():
        if target not in merged:
            raise ValueError(f"unknown alias target {target!r}; one of {sorted(merged)}")
        merged[target] = [*merged[target], *[n for n in names if n not in merged[target]]]
    return merged


def normalize(
    df: DataFrame,
    ingest_ts=None,
    ref_year: int | None = None,
    extra_aliases: dict[str, list[str]] | None = None,
    cef_severity_scale: bool = False,
    universal: bool = False,
) -> DataFrame:
    """F -> E: the input's columns plus the event's ten and ``timestamp_source``.

    ``universal``: fields may carry the universal names themselves, as after ``map_fields``.
    """
    extra = tuple((k, tuple(v)) for k, v in (extra_aliases or {}).items())
    rules = frozenset(df.columns) & {"vendor", "device_type"}
    for step in _steps(ingest_ts, ref_year, extra, cef_severity_scale, universal, rules):
        df = df.withColumns(step)
    return df.drop(*[n for n in df.columns if n.startswith("_")])


@remembered
def _steps(ingest_ts, ref_year, extra: tuple, cef_severity_scale: bool, universal: bool, rules: frozenset) -> list[dict[str, Column]]:
    """The columns of ``normalize``, in the order in which they read each other."""
    aliases = _merged({k: list(v) for k, v in extra})
    a = universal_aliases(aliases) if universal else aliases
    ingest = _ingest(ingest_ts)
    user, source_user, destination_user = _user_parts(a)
    process, pid = _process_parts(a)
    picked = {
        **_identity(rules, a),
        "_src_ip": ip_value(a["source_ip"]),
        "_dst_ip": ip_value(a["destination_ip"]),
        "_src_port": port_value(a["source_port"]),
        "_dst_port": port_value(a["destination_port"]),
        "_protocol": alias_value(a["protocol"]),
        "_action": alias_value(a["action"]),
        # First present, even if blank. A higher-order function also keeps this projection, far
        # too wide for one generated method, out of whole-stage code generation.
        "_severity": F.get(F.array_compact(F.array(*[F.col(FIELDS)[n] for n in a["severity"]])), F.lit(0)),
        "_time": alias_value(a["timestamp"]),
        "_user": user,
        "_source_user": source_user,
        "_destination_user": destination_user,
        "_process": process,
        "_pid": pid,
        "_sent": long_value(a["bytes_sent"]),
        "_received": long_value(a["bytes_received"]),
        "_packets": from_map("{v} is not null", a["packets"]).try_cast("bigint"),
        "_type": F.coalesce(_filled(a["event_type"]), F.lit("connection")),
        "_raw_category": _filled(a["category"]),
        "_message": _filled(a["message"]),
        "_threat_text": F.lower(_filled(a["threat_text"])),
    }
    c = F.col
    cef_rows = (c("format") == "CEF") if cef_severity_scale else None
    labelled = {
        "_protocol": protocol_label(c("_protocol")),
        "_action": action_label(c("_action")),
        "_severity": severity_label(c("_severity"), cef_rows),
        "_read": parse_timestamp(c("_time"), _year(ref_year, ingest)),
        **threat.text_and_address_findings(c("_threat_text"), c("_src_ip"), c("_dst_ip")),
    }
    judged = {
        "_category": category_label(c("_raw_category"), c("_action"), c("_message")),
        "_port_kind": threat.port_type(c("_dst_port"), c("_action")),
    }
    scored = {"threat_intel": threat.intel_of_findings(c("_action"), c("_severity"), c("_dst_port"), c("_sent"))}
    intel = c("threat_intel")
    record = {
        "event_id": id_value("evt_", c("file_path"), c("line_no"), c("line")),
        "timestamp": F.coalesce(c("_read"), ingest),
        "timestamp_source": F.when(c("_read").isNotNull(), "event").otherwise("ingest"),
        "source": _source_struct(),
        "event": F.struct(
            c("_category").alias("category"), c("_type").alias("type"),
            c("_action").alias("action"), c("_severity").alias("severity"),
        ),
        "network": F.struct(
            c("_src_ip").alias("source_ip"), c("_dst_ip").alias("destination_ip"),
            c("_src_port").alias("source_port"), c("_dst_port").alias("destination_port"),
            c("_protocol").alias("protocol"), c("_sent").alias("bytes_sent"),
            c("_received").alias("bytes_received"), c("_packets").alias("packets"),
        ),
        "user": _user_struct(c("_user"), c("_source_user"), c("_destination_user")),
        "process": _process_struct(c("_process"), c("_pid")),
        "metadata": _metadata_struct(
            tags_value(c("format"), c("_device"), intel["threat_detected"], intel["threat_type"],
                       c("_category")),
            ingest,
        ),
        "raw_event": c("line"),
    }
    return [picked, labelled, judged, scored, record]
