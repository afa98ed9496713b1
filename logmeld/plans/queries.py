"""The registered queries, one per operator, each with its reference SQL where SQL can say it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmeld import vocab
from logmeld.operators import analytics as an
from logmeld.operators import (
    cef, delimited, detect, json_object, key_value, leef, normalize, search, syslog, threat, validate,
)
from logmeld.operators.registry import Parser
from logmeld.plans import fixture_lines as fx
from logmeld.plans import inputs as src
from logmeld.plans import process as pr
from logmeld.plans.expected import over, over_truth
from logmeld.sources import page_runs, rollups, tables, text_lines, writers
from logmeld.session import scratch_path, tune

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def get(*names: str, col: str = "fields") -> list:
    """Named members of the fields map as columns; dots become underscores."""
    return [c(col)[n].alias(n.replace(".", "_").replace("-", "_")) for n in names]


# ---- scans ------------------------------------------------------------------------------

@query("s1_read_log_lines", over_truth(
    "select count(*) as n, count(*) as n_places, count(distinct event_id) filter (is_bad = 1 and tpl % 2 = 1) as n_notes from base"))
def _(spark, sf):
    rows = text_lines.read_log_lines(spark, src.text_files(spark, sf))
    note = F.when(c("line").startswith("console note"), c("line"))
    return rows.agg(
        F.count("*").alias("n"), F.count_distinct("file_path", "line_no").alias("n_places"),
        F.count_distinct(note).alias("n_notes"))


@query("s2_multi_file_scan", over_truth("select count(*) as n, count(distinct folder) as n_dirs from (select 'a' as folder from base union all select 'b' from base)"))
def _(spark, sf):
    def make():
        path = scratch_path(spark, "text2")
        src.rendered(spark, sf).select("line").write.text(path)
        return path

    other = src.once(spark, sf, "text2", make)
    rows = text_lines.read_log_lines(spark, [src.text_files(spark, sf), other])
    folder = F.regexp_extract("file_path", "/([^/]+)/[^/]+$", 1)
    return rows.agg(F.count("*").alias("n"), F.count_distinct(folder).alias("n_dirs"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_PIECES = (
    "with p as (select doc_id, lang, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')) as piece from documents)"
)


@query("s3_explode_lines", f"{_PIECES} select doc_id, count(*) as n_lines, cast(sum(length(trim(piece, {_WS}))) as bigint) as n_chars from p where trim(piece, {_WS}) <> '' group by doc_id")
def _(spark, sf):
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    return text_lines.explode_lines(docs, "text").groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("s4_blank_lines", f"{_PIECES} select lang, count(*) as n_lines from p where trim(piece, {_WS}) <> '' group by lang")
def _(spark, sf):
    docs = src.table(spark, sf, "documents")
    pieces = docs.select("lang", F.explode(F.split("text", text_lines._BREAKS)).alias("line"))
    return pr.drop_blank(pieces).groupBy("lang").agg(F.count("*").alias("n_lines"))


def _scanned(spark, sf):
    return detect.detect_format(text_lines.read_log_lines(spark, src.text_files(spark, sf)))


@query("s5_json_lines_scan", over("select format, confidence, count(*) as n from ok where format = 'JSON' group by format, confidence"))
def _(spark, sf):
    counts = _scanned(spark, sf).groupBy("format", "confidence").agg(F.count("*").alias("n"))
    return counts.filter(c("format") == "JSON")


@query("s6_csv_lines_scan", over("select format, confidence, count(*) as n from ok where format = 'CSV' group by format, confidence"))
def _(spark, sf):
    counts = _scanned(spark, sf).groupBy("format", "confidence").agg(F.count("*").alias("n"))
    return counts.filter(c("format") == "CSV")


@query("s8_read_events", over("select source_ip, destination_ip, action, severity, category, timestamp from ok"))
def _(spark, sf):
    e = tables.decode_events(src.flat(spark, sf))
    return e.select("network.source_ip", "network.destination_ip", "event.action", "event.severity",
                    "event.category", "timestamp")


# ---- sinks ------------------------------------------------------------------------------

_WRITTEN = over(
    "select 'evt_' || cast(line_no as string) as event_id, timestamp, vendor as source_vendor, device_type as source_device_type, hostname, source_ip, destination_ip, source_port, destination_port, protocol, action, severity, category, threat_detected, threat_type, risk_score, timestamp '2024-03-01 00:00:00' as created_at from ok")


@query("k1_write_events", _WRITTEN)
def _(spark, sf):
    path = scratch_path(spark, "events")
    writers.write_events(src.events(spark, sf), path, compact=True)
    return tables.read_events(spark, path).drop("normalized_json", "raw_event", "event_date")


@query("k1b_upsert_events", _WRITTEN)
def _(spark, sf):
    path = scratch_path(spark, "events")
    e = src.events(spark, sf)
    for part in (e.limit(1000), e, e):
        writers.upsert_events(part, path, fx.INGEST_TS)
    return tables.read_events(spark, path).drop("normalized_json", "raw_event", "event_date")


_LATER = _WRITTEN.replace(" timestamp, vendor as", " timestamp + case when timestamp_source = 'ingest' then interval 1 day else interval 0 day end as timestamp, vendor as").replace(
    "timestamp '2024-03-01 00:00:00' as created_at", "timestamp '2024-03-02 00:00:00' as created_at")


@query("k1c_upsert_across_dates", _LATER)
def _(spark, sf):
    """The same lines on two days, then some of the first day's rows again: events without a time of their own move to the second day."""
    path = scratch_path(spark, "events")
    e = src.events(spark, sf)
    moved = e.withColumn("timestamp", F.when(c("timestamp_source") == "ingest", c("timestamp") + F.expr("interval 1 day")).otherwise(c("timestamp")))
    writers.upsert_events(e, path, fx.INGEST_TS)
    writers.upsert_events(moved, path, "2024-03-02 00:00:00")
    writers.upsert_events(e.filter(c("line_no") % 3 == 0), path, fx.INGEST_TS)
    return tables.read_events(spark, path).drop("normalized_json", "raw_event", "event_date")


@query("k2_latest_by_key", "select event_id, ts, user_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1")
def _(spark, sf):
    rows = src.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return writers.latest_by_key(rows, "user_id", "event_id")


_QUARANTINE = over("select line_no, file_path, raw_event, reason, detected_format, parser_attempted from bad")


@query("k3_write_quarantine", _QUARANTINE)
def _(spark, sf):
    path = scratch_path(spark, "quarantine")
    writers.write_quarantine(src.quarantine(spark, sf), path)
    return spark.read.parquet(path).drop("event_id", "timestamp")


@query("k3b_upsert_quarantine", _QUARANTINE)
def _(spark, sf):
    path = scratch_path(spark, "quarantine")
    for _ in range(2):
        writers.upsert_quarantine(src.quarantine(spark, sf), path)
    return spark.read.parquet(path).drop("event_id", "timestamp", "failed_date")


@query("k3c_upsert_quarantine_again", over("select line_no, file_path, raw_event, reason, detected_format, parser_attempted, timestamp '2024-03-02 00:00:00' as timestamp from bad"))
def _(spark, sf):
    path = scratch_path(spark, "quarantine")
    q = src.quarantine(spark, sf)
    for at in ("2024-03-01 00:00:00", "2024-03-02 00:00:00"):
        writers.upsert_quarantine(q.withColumn("timestamp", F.lit(at).cast("timestamp")), path)
    return spark.read.parquet(path).drop("event_id", "failed_date")


@query("k4_record_batch", over("select count(*) as total_events, count(*) filter (outcome = 'event') as normalized_count, count(*) filter (outcome = 'failed') as failed_count, count(*) / 2.0 as events_per_second, cast(count(*) as string) as json_total from exp"))
def _(spark, sf):
    path = scratch_path(spark, "batches")
    summary = an.batch_summary(src.events(spark, sf), src.quarantine(spark, sf), 2.0)
    writers.record_batch(summary, path, fx.INGEST_TS)
    return spark.read.parquet(path).select(
        "total_events", "normalized_count", "failed_count", "events_per_second",
        F.get_json_object("summary_json", "$.total_events").alias("json_total"))


@query("k4b_upsert_batch", over("select count(*) as total_events, count(*) filter (outcome = 'event') as normalized_count from exp"))
def _(spark, sf):
    path = scratch_path(spark, "batches")
    summary = an.batch_summary(src.events(spark, sf), src.quarantine(spark, sf), 2.0).withColumn("batch_id", F.lit("batch_1"))
    for at in ("2024-03-01 00:00:00", "2024-03-01 00:00:01"):
        writers.upsert_batch(summary, path, at)
    return spark.read.parquet(path).select("total_events", "normalized_count")


@query("k4c_ingest_batch", over("select count(*) as total_events, count(*) filter (outcome = 'event') as normalized_count, count(*) filter (outcome = 'failed') as failed_count, count(*) as n_rows, 'b' as batch_id from exp"))
def _(spark, sf):
    """A batch that runs twice: its row holds what the writing run has counted."""
    path, batches = scratch_path(spark, "ingested"), scratch_path(spark, "batches")
    for _ in range(2):
        writers.ingest(src.lines(spark, sf), path, batches, "b", mode="overwrite", ingest_ts=fx.INGEST_TS, ref_year=fx.REF_YEAR)
    n = spark.read.parquet(path).filter("outcome <> 'skipped'").agg(F.count("*").alias("n_rows")).scalar()
    return spark.read.parquet(batches).select("batch_id", "total_events", "normalized_count", "failed_count", n.alias("n_rows"))


_ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_EXPORTED = f"select 'evt_' || cast(line_no as string) as event_id, {_ISO} as timestamp, source_ip, action, type, threat_type from ok"


@query("k5_export_jsonl", over(_EXPORTED))
def _(spark, sf):
    path = scratch_path(spark, "jsonl")
    writers.export_jsonl(src.events(spark, sf), path)
    at = lambda p, n: F.get_json_object("value", p).alias(n)
    return spark.read.text(path).select(
        at("$.event_id", "event_id"), at("$.timestamp", "timestamp"),
        at("$.network.source_ip", "source_ip"), at("$.event.action", "action"),
        at("$.event.type", "type"), at("$.threat_intel.threat_type", "threat_type"))


@query("k6_export_json", over(_EXPORTED))
def _(spark, sf):
    path = scratch_path(spark, "json")
    writers.export_json(src.events(spark, sf), path)
    schema = tables.EVENT_DDL.replace("timestamp timestamp", "timestamp string").replace(
        "processed_at:timestamp", "processed_at:string")
    return spark.read.schema(schema).json(path).select(
        "event_id", "timestamp", "network.source_ip", "event.action", "event.type",
        "threat_intel.threat_type")


_CSV_ROWS = f"""select 'evt_' || cast(line_no as string) as event_id, {_ISO} as timestamp, vendor, device_type, hostname, category, type as event_type,
 action, severity, source_ip, destination_ip, source_port, destination_port, protocol, bytes_sent, cast(null as bigint) as bytes_received,
 threat_detected, threat_type, mitre_technique_id, risk_score, geo_source, geo_destination, coalesce(user_name, '') as "user",
 coalesce(process_name, '') as process, parser, format as source_format, confidence from ok"""


@query("k7_flatten_for_csv", over(_CSV_ROWS))
def _(spark, sf):
    return writers.flatten_for_csv(src.events(spark, sf)).drop("raw_event")


@query("k7b_export_csv", over(
    f"select 'evt_' || cast(line_no as string) as event_id, {_ISO} as timestamp, vendor, action, cast(risk_score as string) as risk_score, parser from ok"))
def _(spark, sf):
    path = scratch_path(spark, "csv")
    writers.export_csv(src.events(spark, sf), path)
    return spark.read.option("escape", '"').csv(path, header=True).select(
        "event_id", "timestamp", "vendor", "action", "risk_score", "parser")


@query("k8_export_failed_csv", over("select 'fail_' || cast(line_no as string) as event_id, reason, detected_format, parser_attempted, raw_event from bad"))
def _(spark, sf):
    path = scratch_path(spark, "failed")
    writers.export_failed_csv(src.quarantine(spark, sf), path)
    return spark.read.option("escape", '"').csv(path, header=True).drop("timestamp")


@query("k9_align_schema", """select 'c' || cast(c_custkey as string) as event_id, c_name as raw_event, 'network' as category, 0 as risk_score, false as threat_detected from customer
 union all select 's' || cast(s_suppkey as string), s_name, 'system', s_nationkey, s_acctbal < 0 from supplier""")
def _(spark, sf):
    old = src.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("event_id"), c("c_name").alias("raw_event"))
    new = src.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("event_id"), c("s_name").alias("raw_event"),
        F.lit("system").alias("category"), c("s_nationkey").alias("risk_score"),
        (c("s_acctbal") < 0).alias("threat_detected"))
    return writers.align_schema(old, new)


# ---- detection --------------------------------------------------------------------------

def _detected(fn):
    return lambda spark, sf: fn(src.rendered(spark, sf)).select(c("event_id").alias("line_no"), "match", "conf")


def _conf_sql(cases: str, bad: str = "0.0") -> str:
    return over(f"select line_no, conf > 0 as match, conf from (select line_no, cast(case when is_bad = 1 then {bad} else {cases} end as double) as conf from exp)")


query("d1_detect_cef", _conf_sql("case when tpl in (4, 5) then 0.99 else 0.0 end", "case when tpl % 2 = 0 then 0.99 else 0.0 end"))(_detected(detect.detect_cef))
query("d2_detect_leef", _conf_sql("case when tpl in (6, 7) then 0.99 else 0.0 end"))(_detected(detect.detect_leef))
query("d3_detect_json", _conf_sql("case tpl when 8 then 0.99 when 9 then 0.92 else 0.0 end"))(_detected(detect.detect_json))
query("d4_detect_key_value", _conf_sql("case when tpl in (2, 3) then 0.98 when tpl in (0, 4, 5, 6, 10) then 0.95 else 0.0 end"))(_detected(detect.detect_key_value))
query("d5_detect_syslog", _conf_sql("case when tpl = 0 then 0.98 when tpl in (1, 2, 3, 5) then 0.95 else 0.0 end"))(_detected(detect.detect_syslog))
query("d6_detect_csv", _conf_sql("case when tpl = 11 then 0.85 else 0.0 end"))(_detected(detect.detect_csv))

_DETECTED = """select line_no, case when is_bad = 0 then format when tpl % 2 = 0 then 'CEF' end as format,
 case when is_bad = 0 then parser when tpl % 2 = 0 then 'cef-arcsight-v1' end as parser,
 case when is_bad = 0 then confidence when tpl % 2 = 0 then 0.99 else 0.0 end as confidence, tpl, is_bad from exp"""


@query("d7_detect_format", over(f"select line_no, format, parser, confidence from ({_DETECTED})"))
def _(spark, sf):
    return detect.detect_format(src.rendered(spark, sf)).select(
        c("event_id").alias("line_no"), "format", "parser", "confidence")


@query("d8_forced_parser", over(f"""select line_no, case line_no % 3 when 0 then 'SYSLOG' when 1 then null else format end as format,
 case line_no % 3 when 0 then 'syslog-rfc3164-5424' when 1 then 'no-such-parser' else parser end as parser,
 case when line_no % 3 = 2 then confidence else 1.0 end as confidence from ({_DETECTED})"""))
def _(spark, sf):
    rows = src.rendered(spark, sf).withColumn("forced_parser", F.expr(
        "case event_id % 3 when 0 then 'syslog-rfc3164-5424' when 1 then 'no-such-parser' end"))
    return detect.detect_format(rows, c("forced_parser")).select(
        c("event_id").alias("line_no"), "format", "parser", "confidence")


@query("d9_reject_undetected", over(
    "select line_no, case when is_bad = 1 and tpl % 2 = 1 then 'No suitable parser detected (confidence=0.00; line_prefix=''console note without structure ' || cast(line_no as string) || ''')' end as reason from exp"))
def _(spark, sf):
    return detect.reject_undetected(detect.detect_format(src.rendered(spark, sf))).select(
        c("event_id").alias("line_no"), "reason")


@query("d10_parser_catalog", over(f"""select parser, d.format, cat.vendor, cat.device_type, count(*) as n from ({_DETECTED}) d
 join (values {", ".join(str((p, v, t)) for p, f, v, t in vocab.PARSERS)}) cat(name, vendor, device_type) on d.parser = cat.name
 group by parser, d.format, cat.vendor, cat.device_type"""))
def _(spark, sf):
    counts = detect.detect_format(src.rendered(spark, sf)).groupBy("parser").agg(F.count("*").alias("n"))
    return detect.parser_catalog(spark).join(counts, "parser")


@query("d11_detection_profile", over(f"select format, count(*) as n, round(avg(confidence), 6) as mean_confidence from ({_DETECTED}) group by format"))
def _(spark, sf):
    profile = detect.detection_profile(detect.detect_format(src.rendered(spark, sf)))
    return profile.withColumn("mean_confidence", F.round("mean_confidence", 6))


def _own_parsers() -> list[Parser]:
    """Three parsers of our own: notes of a console, one that claims all lines too late, and one that ties with delimited lines."""
    words = lambda line: F.create_map(F.lit("message"), line, F.lit("event_type"), F.lit("note"), F.lit("pid"), F.regexp_extract(line, r"(\d+)$", 1))
    return [
        Parser("console-note-v1", "CONSOLE", lambda line: F.when(line.startswith("console note"), 0.5), words, "Console", "server"),
        Parser("anything-v1", "ANY", lambda line: F.lit(0.5), words),
        Parser("tie-v1", "TIE", lambda line: F.when(line.contains("PulseSecure"), 0.85), words),
    ]


@query("d12_own_parsers", over(f"""select line_no, case when is_bad = 1 and tpl % 2 = 1 then 'CONSOLE' else format end as format,
 case when is_bad = 1 and tpl % 2 = 1 then 'console-note-v1' else parser end as parser,
 case when is_bad = 1 and tpl % 2 = 1 then 0.5 else confidence end as confidence from ({_DETECTED})"""))
def _(spark, sf):
    return detect.detect_format(src.rendered(spark, sf), parsers=_own_parsers()).select(
        c("event_id").alias("line_no"), "format", "parser", "confidence")


@query("r4b_process_own_parsers", over("""select line_no, outcome_ as outcome, case when is_note then 'CONSOLE' else format_ end as detected_format,
 case when is_note then 'Console' else vendor_ end as vendor, case when is_note then 'note' end as note_type, case when is_note then cast(line_no as string) end as note_pid
 from (select *, is_bad = 1 and tpl % 2 = 1 as is_note, case when is_bad = 1 and tpl % 2 = 0 then 'failed' else 'event' end as outcome_,
  case when is_bad = 1 then 'CEF' else format end as format_, case when is_bad = 1 then null else vendor end as vendor_ from exp)"""))
def _(spark, sf):
    done = pr.process(src.rendered(spark, sf).select("line", "file_path", "line_no"), ingest_ts=fx.INGEST_TS, ref_year=fx.REF_YEAR, headers=None, parsers=_own_parsers())
    note = c("detected_format") == "CONSOLE"
    return done.select(
        "line_no", "outcome", "detected_format", F.when(c("outcome") == "event", c("source.vendor")).alias("vendor"),
        F.when(note, c("event.type")).alias("note_type"), F.when(note, c("process.pid")).alias("note_pid"))


# ---- extraction -------------------------------------------------------------------------

def _of(spark, sf, fmt: str) -> DataFrame:
    """Rendered lines of one detected format."""
    return src.detected(spark, sf).filter(c("format") == fmt)


@query("p1_cef_header", over("""select line_no, case when ok then '0' end as cef_version, case when ok then 'Acme' end as vendor,
 case when ok then case tpl when 4 then 'Gate Firewall' else 'Gate VPN' end end as product, case when ok then '1.0' end as device_version,
 case when ok then cast(line_no as string) end as signature_id, case when ok then 'Flow' end as event_name, case when ok then cast(sev_code as string) end as cef_severity,
 case when ok then case tpl when 5 then '<134>' || bsd || ' relay' else '' end end as prefix,
 case when not ok then 'ValueError: Line does not conform to CEF format: CEF:bad|only|two' end as error
 from (select *, is_bad = 0 as ok from exp) where (ok and tpl in (4, 5)) or (not ok and tpl % 2 = 0)"""))
def _(spark, sf):
    return cef.parse_cef(_of(spark, sf, "CEF")).select(
        "line_no", "cef_version", "vendor", "product", "device_version", "signature_id", "event_name",
        "cef_severity", "prefix", "error")


@query("p2_cef_pairs", over("""select line_no, src_ip as src, dst_ip as dst, case when tpl = 4 then cast(src_port as string) end as spt, cast(dst_port as string) as dpt,
 case when tpl = 4 then proto_raw end as proto, action_raw as act, case when tpl = 4 then cast(raw_bytes as string) end as out, case when tpl = 5 then 'a=b' end as cs1, msg from ok where format = 'CEF'"""))
def _(spark, sf):
    rows = cef.cef_pairs(cef.parse_cef(_of(spark, sf, "CEF")))
    named = rows.select("line_no", "error", *get("src", "dst", "spt", "dpt", "proto", "act", "out", "cs1", "msg"))
    return named.filter(c("error").isNull()).drop("error")


@query("p3_cef_device_type", over("select line_no, device_type from ok where format = 'CEF'"))
def _(spark, sf):
    rows = cef.cef_device_type(cef.parse_cef(_of(spark, sf, "CEF"))).select("line_no", "error", "device_type")
    return rows.filter(c("error").isNull()).drop("error")


@query("p4_leef_fields", over("""select line_no, 'Acme' as vendor, case tpl when 6 then 'Gate' else 'IDS box' end as product, cast(line_no as string) as event_name, src_ip as src, dst_ip as dst,
 cast(dst_port as string) as dpt, action_raw as act, hostname as devname, case when tpl = 7 then msg end as msg, cast(null as string) as error from ok where format = 'LEEF'"""))
def _(spark, sf):
    return leef.parse_leef(_of(spark, sf, "LEEF")).select(
        "line_no", *get("vendor", "product", "event_name", "src", "dst", "dpt", "act", "devname", "msg"), "error")


@query("p4b_leef_device_type", over("select line_no, device_type from ok where format = 'LEEF'"))
def _(spark, sf):
    rows = leef.parse_leef(_of(spark, sf, "LEEF")).withColumn("product", c("fields")["product"])
    return leef.leef_device_type(rows).select("line_no", "device_type")


@query("p5_parse_json", "select event_id, json_extract_string(props, '$.k') as k, cast(null as string) as error from events")
def _(spark, sf):
    rows = src.table(spark, sf, "events").select("event_id", c("props").alias("line"))
    return json_object.parse_json(rows).select("event_id", *get("k"), "error")


@query("p6_flatten_json", over("""select line_no, case tpl when 9 then '1' end as flow_a, case tpl when 9 then '[1,{"c":2}]' end as flow_b, case tpl when 9 then '1' end as flow_b_0,
 case tpl when 9 then '2' end as flow_b_1_c, case tpl when 8 then msg end as alert_signature, case tpl when 8 then cast(sev_code as string) end as alert_severity from ok where format = 'JSON'"""))
def _(spark, sf):
    return json_object.flatten_json(_of(spark, sf, "JSON")).select(
        "line_no", *get("flow.a", "flow.b", "flow.b.0", "flow.b.1.c", "alert.signature", "alert.severity"))


@query("p7_suricata_fields", over("""select line_no, case tpl when 8 then 'Suricata' end as vendor, case tpl when 8 then 'ids' end as device_type, case tpl when 8 then msg end as event_name,
 case tpl when 8 then cast(sev_code as string) end as severity from ok where format = 'JSON'"""))
def _(spark, sf):
    rows = json_object.flatten_json(_of(spark, sf, "JSON"))
    return json_object.suricata_fields(rows).select("line_no", "vendor", "device_type", *get("event_name", "severity"))


@query("p8_zeek_fields", over_truth("""select event_id, 'Zeek' as vendor, 'ids' as device_type, src_ip, dst_ip, cast(src_port as string) as sport, cast(dst_port as string) as dport, 'tcp' as protocol from base"""))
def _(spark, sf):
    rows = src.truth(spark, sf).withColumn("line", F.expr("""
      case when event_id % 2 = 0 then format_string('{"uid":"C%s","id":{"orig_h":"%s","orig_p":%s,"resp_h":"%s","resp_p":%s},"proto":"tcp"}', event_id, src_ip, src_port, dst_ip, dst_port)
      else format_string('{"uid":"C%s","id.orig_h":"%s","id.orig_p":%s,"id.resp_h":"%s","id.resp_p":%s,"proto":"tcp"}', event_id, src_ip, src_port, dst_ip, dst_port) end"""
    )).select("event_id", "line")
    return json_object.zeek_fields(json_object.flatten_json(rows)).select(
        "event_id", "vendor", "device_type", *get("src_ip", "dst_ip", "sport", "dport", "protocol"))


_JSON_MARKS = [("snort", "Snort", "ids"), ("Zeek conn", "Zeek", "ids"), ("fortigate devname", "Fortinet", "firewall"),
               ("aws cloudtrail", "AWS", "cloud"), ("azure", None, None), ("F5 BigIP", "F5", "load_balancer"), ("plain", None, None)]


def _case(table: list, at: int, on: str) -> str:
    arms = " ".join(f"when {i} then '{row[at]}'" for i, row in enumerate(table) if row[at] is not None)
    return f"case {on} {arms} end"


@query("p9_json_vendor", f"select event_id, {_case(_JSON_MARKS, 1, 'event_id % 7')} as vendor, {_case(_JSON_MARKS, 2, 'event_id % 7')} as device_type from events")
def _(spark, sf):
    rows = src.table(spark, sf, "events").select("event_id", F.expr(
        f"concat('{{\"product\":\"', {_case(_JSON_MARKS, 0, 'event_id % 7')}, '\"}}')").alias("line"))
    return json_object.json_vendor(rows).select("event_id", "vendor", "device_type")


@query("p10_json_device_fallback", "select event_id, case event_id % 4 when 0 then 'firewall' when 1 then 'firewall' when 2 then 'vpn' end as device_type from events")
def _(spark, sf):
    rows = src.table(spark, sf, "events").select("event_id", F.expr(
        "case event_id % 4 when 0 then '{\"Firewall\":1}' when 1 then '{\"rule_name\":\"x\",\"vpn\":{\"a\":1}}' when 2 then '{\"tunnel\":null}' else '{\"vpn\":{\"firewall\":2}}' end").alias("line"),
        F.lit(None).cast("string").alias("device_type"))
    return json_object.json_device_fallback(rows).select("event_id", "device_type")


@query("p11_key_value_pairs", over("select line_no, src_ip as srcip, dst_ip as dstip, cast(src_port as string) as srcport, proto_raw as proto, action_raw as action, cast(raw_bytes as string) as sentbyte, 'warning' as level, msg from ok where tpl = 10"))
def _(spark, sf):
    rows = key_value.parse_key_value(_of(spark, sf, "KEY_VALUE").filter(c("tpl") == 10))
    return rows.select("line_no", *get("srcip", "dstip", "srcport", "proto", "action", "sentbyte", "level", "msg"))


@query("p12_cisco_asa", over("""select line_no, case tpl when 2 then 'Cisco' end as vendor, case tpl when 2 then 'ASA-ASA' end as product, case tpl when 2 then 'Deny' end as action, case tpl when 2 then 'tcp' end as protocol,
 case tpl when 2 then src_ip end as src_ip, case tpl when 2 then cast(src_port as string) end as src_port, case tpl when 2 then dst_ip end as dst_ip, case tpl when 2 then cast(dst_port as string) end as dst_port,
 case tpl when 2 then cast(sev_code as string) end as severity_code, case tpl when 2 then '106023' end as cisco_message_id from ok where format = 'KEY_VALUE'"""))
def _(spark, sf):
    return key_value.parse_cisco_asa(_of(spark, sf, "KEY_VALUE")).select("line_no", *get(
        "vendor", "product", "action", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "severity_code", "cisco_message_id"))


@query("p13_kv_vendor", over("select line_no, nullif(vendor, 'Generic') as vendor, nullif(device_type, 'network_device') as device_type from ok where format = 'KEY_VALUE'"))
def _(spark, sf):
    return key_value.kv_vendor(_of(spark, sf, "KEY_VALUE")).select("line_no", "vendor", "device_type")


@query("p14_rfc5424", over("""select line_no, cast(160 + sev_code as string) as pri, '20' as facility, cast(sev_code as string) as severity_code, iso as timestamp, hostname, 'TRAFFIC' as app_name, '-' as proc_id, '-' as msg_id,
 'src=' || src_ip || ' dst=' || dst_ip || ' sport=' || cast(src_port as string) || ' dport=' || cast(dst_port as string) || ' proto=' || proto_raw || ' action=' || action_raw || ' bytes_sent=' || cast(raw_bytes as string) || ' note ' || msg as message from ok where tpl = 0"""))
def _(spark, sf):
    rows = syslog.parse_rfc5424(_of(spark, sf, "SYSLOG")).select("line_no", "fields")
    named = rows.select("line_no", c("fields").isNotNull().alias("hit"), *get(
        "pri", "facility", "severity_code", "timestamp", "hostname", "app_name", "proc_id", "msg_id", "message"))
    return named.filter("hit").drop("hit")


@query("p14b_structured_data", over_truth("select event_id, 'u' || cast(user_id as string) as ex_user, 'u' || cast(user_id as string) as user_flat, cast(sev_code as string) as ex_code, msg as meta_note, msg as note from base"))
def _(spark, sf):
    rows = src.truth(spark, sf).select("event_id", F.expr(
        "format_string('[ex@1 User=\"u%s\" code=\"%s\"][meta note=\"%s\"]', user_id, sev_code, msg)").alias("sd"))
    f = c("fields")
    return syslog.structured_data(rows, "sd").select(
        "event_id", f["ex@1.user"].alias("ex_user"), f["user"].alias("user_flat"), f["ex@1.code"].alias("ex_code"),
        f["meta.note"].alias("meta_note"), f["note"].alias("note"))


@query("p15_rfc3164", over("""select line_no, cast(160 + sev_code as string) as pri, '20' as facility, bsd as timestamp, hostname, 'sshd' as app_name, cast(user_id as string) as pid, msg as message from ok where tpl = 1"""))
def _(spark, sf):
    rows = syslog.parse_rfc3164(_of(spark, sf, "SYSLOG")).select("line_no", c("fields").isNotNull().alias("hit"), *get(
        "pri", "facility", "timestamp", "hostname", "app_name", "pid", "message"))
    return rows.filter("hit").drop("hit")


@query("p15b_pri_only", over_truth("select event_id, case when event_id % 3 = 0 then cast(sev_code + 8 as string) end as pri, case when event_id % 3 = 0 then '1' end as facility, case when event_id % 3 = 2 then 'no mark ' || msg else msg end as message from base"))
def _(spark, sf):
    rows = src.truth(spark, sf).select("event_id", F.expr(
        "case event_id % 3 when 0 then concat('<', sev_code + 8, '> ', msg) when 1 then concat('<x>', msg) else concat('no mark ', msg) end").alias("line"))
    return syslog.parse_pri_only(rows).select("event_id", *get("pri", "facility", "message"))


@query("p15c_message_pairs", over("select line_no, src_ip as src, dst_ip as dst, cast(src_port as string) as sport, action_raw as action, cast(raw_bytes as string) as bytes_sent, hostname from ok where tpl = 0"))
def _(spark, sf):
    rows = syslog.parse_rfc5424(_of(spark, sf, "SYSLOG")).filter(c("tpl") == 0)
    return syslog.message_pairs(rows).select("line_no", *get("src", "dst", "sport", "action", "bytes_sent", "hostname"))


_SYSLOG_MARKS = [
    ("%ASA-4-106023: x", "Cisco", "firewall"), ("cisco ftd unit", "Cisco", "firewall"), ("Cisco ios box", "Cisco", "router"),
    ("cisco catalyst 9000", "Cisco", "switch"), ("cisco thing", "Cisco", None), ("devid=\"FG1\"", "Fortinet", "firewall"),
    ("TRAFFIC,2024/01/02 x", "PaloAlto", "firewall"), ("product=Check Point", "CheckPoint", "firewall"), ("srx RT_FLOW", "Juniper", "firewall"),
    ("kern message", "Juniper", "router"), ("snort hit", "OpenSource", "ids"), ("BIG-IP up", "F5", "load_balancer"),
    ("Sophos note", "Sophos", "firewall"), ("my vpn", None, "vpn"), ("nothing known", None, None),
]


@query("p16_syslog_vendor", f"select event_id, {_case(_SYSLOG_MARKS, 1, 'event_id % 15')} as vendor, {_case(_SYSLOG_MARKS, 2, 'event_id % 15')} as device_type from events")
def _(spark, sf):
    rows = src.table(spark, sf, "events").select("event_id", F.expr(
        f"concat('<14>Jan 01 00:00:00 edge ', {_case(_SYSLOG_MARKS, 0, 'event_id % 15')}, ' ', user_id)").alias("line"))
    return syslog.syslog_vendor(rows).select("event_id", "vendor", "device_type")


_BY_DELIM = "case event_id % 4 when 0 then ',' when 1 then ';' when 2 then chr(9) else '|' end"


def _delimited_lines(spark, sf):
    return src.truth(spark, sf).withColumn("line", F.expr(
        f"concat_ws({_BY_DELIM}, event_id, '\"a, ; |b\"', '\"say \"\"hi\"\"\"', '', concat(' ', src_ip, ' '), msg)")).select("event_id", "line")


@query("p17_sniff_delimiter", f"select event_id, {_BY_DELIM} as delim from events")
def _(spark, sf):
    return delimited.sniff_delimiter(_delimited_lines(spark, sf)).select("event_id", "delim")


@query("p18_split_delimited", over_truth("select event_id, 6 as n, cast(event_id as string) as c0, 'a, ; |b' as c1, 'say \"hi\"' as c2, '' as c3, ' ' || src_ip || ' ' as c4, msg as c5 from base"))
def _(spark, sf):
    rows = delimited.split_delimited(delimited.sniff_delimiter(_delimited_lines(spark, sf)))
    return rows.select("event_id", F.size("cells").alias("n"), *[c("cells")[i].alias(f"c{i}") for i in range(6)])


_HEADERISH = [("timestamp,src_ip,note", True), ("Timestamp, ACTION ,x,1", True), ("time,1,2,action", False), ("a,b,c,d", False),
              ("2024,10.0.0.1,allow", False), ("user,message", False), ("port,port,7,8", False)]


@query("p19_is_header_row", "select event_id, case when event_id % 7 in (0, 1) then true else false end as is_header from events")
def _(spark, sf):
    rows = src.table(spark, sf, "events").select("event_id", F.expr(_case(_HEADERISH, 0, "event_id % 7")).alias("line"))
    cells = delimited.split_delimited(rows.withColumn("delim", F.lit(",")))
    return delimited.is_header_row(cells).select("event_id", "is_header")


# Every 500th order starts a new header in its file; the column order alternates.
_ORDER_ROWS = """select o_orderkey, 'h' || cast(o_custkey % 5 as string) as file_path, o_orderkey as line_no, o_orderpriority,
 o_orderstatus, cast(o_custkey as string) as cust, o_orderkey % 500 < 6 as is_head, o_orderkey % 1000 < 6 as swapped from orders"""


def _order_lines(spark, sf):
    rows = src.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('h', o_custkey % 5) as file_path", "o_orderkey as line_no", "o_orderpriority",
        "o_orderstatus", "cast(o_custkey as string) as cust", "o_orderkey % 500 < 6 as is_head", "o_orderkey % 1000 < 6 as swapped")
    line = F.expr("""case when is_head and swapped then 'user,status,type' when is_head then 'status,user,type'
      else concat(o_orderstatus, ',', cust, ',', o_orderpriority) end""")
    lines = rows.withColumn("line", line).withColumn("delim", F.lit(","))
    return delimited.split_delimited(lines)


_ORDER_FIELDS = f"""with r as ({_ORDER_ROWS}), h as (select *, last_value(case when is_head then cast(swapped as integer) end ignore nulls)
  over (partition by file_path order by line_no rows between unbounded preceding and 1 preceding) as head from r)
 select o_orderkey, case head when 1 then cust when 0 then o_orderstatus end as status, case head when 1 then o_orderstatus when 0 then cust end as "user",
  case when head is not null then o_orderpriority end as type, case when head is null then o_orderstatus end as col_0 from h where not is_head"""


@query("p20_apply_headers", _ORDER_FIELDS)
def _(spark, sf):
    rows = delimited.apply_headers(_order_lines(spark, sf))
    return rows.select("o_orderkey", *get("status", "user", "type", "col_0"))


@query("p20b_apply_headers_shuffled", _ORDER_FIELDS)
def _(spark, sf):
    cells = c("cells")
    carried = delimited.with_headers_shuffled(_order_lines(spark, sf), block=1000)
    named = delimited.last_wins(delimited.named_entries(cells, c("header")))
    return carried.select("o_orderkey", "is_head", named.alias("fields")).filter(~c("is_head")).select(
        "o_orderkey", *get("status", "user", "type", "col_0"))


@query("p21_paloalto_positional", over_truth("select event_id, src_ip, dst_ip, cast(src_port as string) as src_port, cast(null as string) as dst_port, proto_raw as proto, 'allow' as action from base"))
def _(spark, sf):
    filler = [f"'x{i}'" for i in range(32)]
    for i, value in {7: "src_ip", 8: "dst_ip", 24: "src_port", 25: "'n/a'", 29: "proto_raw", 30: "'allow'"}.items():
        filler[i] = f"cast({value} as string)"
    rows = src.truth(spark, sf).select("event_id", F.expr(f"concat_ws(',', {', '.join(filler)})").alias("line"))
    cells = delimited.split_delimited(rows.withColumn("delim", F.lit(",")))
    base = cells.withColumn("fields", F.map_from_entries(delimited.positional_entries(c("cells"))))
    return delimited.paloalto_positional(base).select("event_id", *get("src_ip", "dst_ip", "src_port", "dst_port", "proto", "action"))


_CSV_MARKS = [("SmartLog a", "CheckPoint", "firewall"), ("pulse tunnel", "PulseSecure", "vpn"), ("AnyConnect vpn", "Cisco", "vpn"),
              ("vpn", None, "vpn"), ("squid", None, "proxy"), ("none", None, None)]


@query("p22_csv_vendor", f"select event_id, {_case(_CSV_MARKS, 1, 'event_id % 6')} as vendor, {_case(_CSV_MARKS, 2, 'event_id % 6')} as device_type from events")
def _(spark, sf):
    rows = src.table(spark, sf, "events").select("event_id", F.expr(
        f"concat(event_id, ',', {_case(_CSV_MARKS, 0, 'event_id % 6')}, ',', user_id)").alias("line"))
    cells = delimited.split_delimited(rows.withColumn("delim", F.lit(",")))
    return delimited.csv_vendor(cells).select("event_id", "vendor", "device_type")


# ---- normalisation ----------------------------------------------------------------------

A = vocab.ALIASES


@query("n1_first_alias", over("select line_no, hostname from ok"))
def _(spark, sf):
    return normalize.first_alias(src.fields(spark, sf), A["hostname"], "hostname").select("line_no", "hostname")


@query("n2_pick_ip", over("select line_no, source_ip, destination_ip from ok"))
def _(spark, sf):
    f = normalize.pick_ip(src.fields(spark, sf), A["source_ip"], "source_ip")
    return normalize.pick_ip(f, A["destination_ip"], "destination_ip").select("line_no", "source_ip", "destination_ip")


@query("n3_valid_ip", over_truth("select event_id, event_id % 5 in (0, 3, 4) as is_valid_ip from base"))
def _(spark, sf):
    rows = src.truth(spark, sf).select("event_id", F.expr(
        "case event_id % 5 when 0 then src_ip when 1 then concat(src_ip, '.1') when 2 then concat('256', substring(dst_ip, 4)) when 3 then '::1' else 'fe80:0:0:0:0:0:0:1' end").alias("ip"))
    return normalize.valid_ip(rows, "ip").select("event_id", "is_valid_ip")


@query("n4_pick_port", over("select line_no, source_port, destination_port from ok"))
def _(spark, sf):
    f = normalize.pick_port(src.fields(spark, sf), A["source_port"], "source_port")
    return normalize.pick_port(f, A["destination_port"], "destination_port").select("line_no", "source_port", "destination_port")


@query("n5_protocol", over_truth("select event_id, case user_id % 3 when 1 then 'UDP' else 'TCP' end as protocol from base"))
def _(spark, sf):
    return normalize.normalize_protocol(src.truth(spark, sf), "proto_raw").select("event_id", "protocol")


@query("n6_action", over_truth("select event_id, case when event_type in ('click', 'view') then 'allow' when event_type in ('purchase', 'signup') then 'deny' else 'alert' end as action from base"))
def _(spark, sf):
    return normalize.normalize_action(src.truth(spark, sf), "action_raw").select("event_id", "action")


@query("n7_severity", over_truth("""select event_id, case when event_id % 4 = 0 then case when sev_code < 2 then 'critical' when sev_code < 4 then 'high' when sev_code = 4 then 'medium' when sev_code = 5 then 'low' else 'informational' end
 when event_id % 4 = 1 then 'high' when event_id % 4 = 2 then 'medium' else 'informational' end as severity from base"""))
def _(spark, sf):
    rows = src.truth(spark, sf).withColumn("raw", F.expr(
        "case event_id % 4 when 0 then cast(sev_code as string) when 1 then ' Error ' when 2 then 'red alert' else 'odd' end"))
    return normalize.normalize_severity(rows, "raw").select("event_id", "severity")


@query("n8_source_identity", over("select line_no, vendor, device_type, hostname, cast(null as string) as ip from ok"))
def _(spark, sf):
    return normalize.source_identity(src.fields(spark, sf)).select(
        "line_no", "source.vendor", "source.device_type", "source.hostname", "source.ip")


_TIMES = """case event_id % 9 when 0 then {iso} when 1 then {bsd} when 2 then {bsd} || ' 2023' when 3 then {sec} when 4 then {ms}
 when 5 then {slash} when 6 then {clf} when 7 then {space} else 'no time' end"""


@query("n9_timestamp", """select event_id, case event_id % 9 when 2 then date_trunc('second', ts) - interval 365 day when 6 then date_trunc('second', ts) - interval 2 hour
 when 4 then date_trunc('millisecond', ts) when 7 then ts when 8 then timestamp '2024-03-01 00:00:00' else date_trunc('second', ts) end as timestamp,
 case event_id % 9 when 8 then 'ingest' else 'event' end as timestamp_source from events""")
def _(spark, sf):
    fmt = lambda p: f'date_format(ts, "{p}")'
    text = _TIMES.format(
        iso=fmt("yyyy-MM-dd'T'HH:mm:ss'Z'"), bsd=fmt("MMM  d HH:mm:ss"), sec="cast(unix_seconds(ts) as string)",
        ms="cast(unix_millis(ts) as string)", slash=fmt("yyyy/MM/dd HH:mm:ss"), clf=fmt("dd/MMM/yyyy:HH:mm:ss '+0200'"),
        space=fmt("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = src.table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    rows = rows.select("event_id", F.expr(text).alias("t"))
    return normalize.normalize_timestamp(rows, "t", fx.REF_YEAR, fx.INGEST_TS).select("event_id", "timestamp", "timestamp_source")


@query("n10_category", over("select line_no, category from ok"))
def _(spark, sf):
    f = normalize.first_alias(src.fields(spark, sf), A["action"], "action")
    return normalize.classify_category(normalize.normalize_action(f, "action")).select("line_no", "category")


@query("n11_user_context", over("select line_no, user_name, cast(null as string) as source_user from ok"))
def _(spark, sf):
    return normalize.user_context(src.fields(spark, sf)).select("line_no", c("user.name").alias("user_name"), "user.source_user")


@query("n12_process_context", over("select line_no, process_name, pid from ok"))
def _(spark, sf):
    return normalize.process_context(src.fields(spark, sf)).select("line_no", c("process.name").alias("process_name"), "process.pid")


@query("n13_safe_long", over("select line_no, bytes_sent, cast(null as bigint) as bytes_received from ok"))
def _(spark, sf):
    f = normalize.safe_long(src.fields(spark, sf), A["bytes_sent"], "bytes_sent")
    return normalize.safe_long(f, A["bytes_received"], "bytes_received").select("line_no", "bytes_sent", "bytes_received")


@query("n14_event_type", over("select line_no, type from ok"))
def _(spark, sf):
    return normalize.event_type(src.fields(spark, sf), "type").select("line_no", "type")


_TAGS = """lower(format) || ',' || device_type || case when threat_detected then ',threat' else '' end || coalesce(',' || lower(threat_type), '') ||
 case when category <> 'network' then ',' || category else '' end"""


@query("n15_tags", over(f"select line_no, {_TAGS} as tags from ok"))
def _(spark, sf):
    e = src.events(spark, sf).select(
        "line_no", c("metadata.source_format").alias("format"), "source.device_type", "threat_intel.threat_detected",
        "threat_intel.threat_type", "event.category")
    return normalize.event_tags(e).select("line_no", F.array_join("tags", ",").alias("tags"))


@query("n16_metadata", over("select line_no, '1.0' as schema_version, parser, format as source_format, confidence, timestamp '2024-03-01 00:00:00' as processed_at from ok"))
def _(spark, sf):
    rows = src.fields(spark, sf).withColumn("tags", F.array("format"))
    return normalize.event_metadata(rows, fx.INGEST_TS).select(
        "line_no", "metadata.schema_version", "metadata.parser", "metadata.source_format", "metadata.confidence", "metadata.processed_at")


@query("n17_event_id", "select doc_id, 'evt_' || substr(sha256(source || '|' || cast(doc_id as string) || '|' || text), 1, 32) as event_id from documents")
def _(spark, sf):
    rows = src.table(spark, sf, "documents").select("doc_id", c("source").alias("file_path"), c("doc_id").alias("line_no"), c("text").alias("line"))
    return normalize.with_event_id(rows).select("doc_id", "event_id")


@query("n18_lossless_raw", over("select count(*) as n, count(*) as n_equal from ok"))
def _(spark, sf):
    given = src.rendered(spark, sf).select(c("event_id").alias("line_no"), "line")
    both = src.events(spark, sf).select("line_no", "raw_event").join(given, "line_no")
    return both.agg(F.count("*").alias("n"), F.count_if(c("raw_event") == c("line")).alias("n_equal"))


_EVENT = """select line_no, timestamp, timestamp_source, vendor, device_type, hostname, category, type, action, severity, source_ip, destination_ip, source_port, destination_port, protocol, bytes_sent,
 user_name, process_name, pid, parser, format as source_format, confidence from ok"""


def _event_columns(e: DataFrame) -> DataFrame:
    return e.select(
        "line_no", "timestamp", "timestamp_source", "source.vendor", "source.device_type", "source.hostname", "event.category",
        "event.type", "event.action", "event.severity", "network.source_ip", "network.destination_ip", "network.source_port",
        "network.destination_port", "network.protocol", "network.bytes_sent", c("user.name").alias("user_name"),
        c("process.name").alias("process_name"), "process.pid", "metadata.parser", "metadata.source_format", "metadata.confidence")


@query("n19_normalize", over(_EVENT))
def _(spark, sf):
    return _event_columns(normalize.normalize(src.fields(spark, sf), fx.INGEST_TS, fx.REF_YEAR))


@query("n20_map_fields", over("select line_no, source_ip, destination_ip, case when tpl in (0, 4, 5, 6, 7, 9) then cast(dst_port as string) end as destination_port from ok"))
def _(spark, sf):
    mapping = spark.createDataFrame(
        [("src", "source_ip", 0), ("src_ip", "source_ip", 1), ("srcip", "source_ip", 2), ("dst", "destination_ip", 0),
         ("dst_ip", "destination_ip", 1), ("dest_ip", "destination_ip", 2), ("dstip", "destination_ip", 3),
         ("dport", "destination_port", 0), ("dpt", "destination_port", 1)],
        "vendor_field string, universal_field string, priority int")
    return normalize.map_fields(src.fields(spark, sf), mapping).select(
        "line_no", *get("source_ip", "destination_ip", "destination_port"))


# ---- threat scoring ---------------------------------------------------------------------

def _labels(spark, sf) -> DataFrame:
    """Events as flat labels."""
    return src.events(spark, sf).select(
        "line_no", "event.action", "event.severity", "network.source_ip", "network.destination_ip", "network.destination_port",
        "network.bytes_sent", "raw_event", "event_id", "timestamp", "network.source_port", "metadata.confidence",
        "metadata.schema_version", "threat_intel.risk_score", "network.bytes_received", "threat_intel.threat_type")


def _texts(spark, sf) -> DataFrame:
    """The same with the text the keyword rules read."""
    f = src.fields(spark, sf)
    text = F.coalesce(*[F.nullif(c("fields")[n], F.lit("")) for n in A["threat_text"]], F.lit(""))
    return _labels(spark, sf).join(f.select("line_no", text.alias("message")), "line_no")


@query("t1_action_score", over("select line_no, action_points as action_score from ok"))
def _(spark, sf):
    return threat.action_score(_labels(spark, sf)).select("line_no", "action_score")


@query("t2_severity_score", over("select line_no, severity_points as severity_score from ok"))
def _(spark, sf):
    return threat.severity_score(_labels(spark, sf)).select("line_no", "severity_score")


@query("t3_port_score", over("select line_no, port_kind as port_type, port_points as port_score from ok"))
def _(spark, sf):
    return threat.port_score(_labels(spark, sf)).select("line_no", "port_type", "port_score")


@query("t4_egress_score", over("select line_no, case when egress then 'DataExfiltration' end as egress_type, egress_points as egress_score from ok"))
def _(spark, sf):
    return threat.egress_score(_labels(spark, sf)).select("line_no", "egress_type", "egress_score")


@query("t5_keyword_score", over("select line_no, case when w_brute then 'BruteForce' when w_scan then 'PortScan' when w_lateral then 'LateralMovement' when w_priv then 'PrivilegeEsc' end as keyword_type, word_points as keyword_score from ok"))
def _(spark, sf):
    return threat.keyword_score(_texts(spark, sf)).select("line_no", "keyword_type", "keyword_score")


@query("t6_is_private_ip", over("select line_no, src_private as is_private from ok"))
def _(spark, sf):
    return threat.is_private_ip(_labels(spark, sf), "source_ip").select("line_no", "is_private")


@query("t7_geo_labels", over("select line_no, geo_source, geo_destination from ok"))
def _(spark, sf):
    return threat.geo_labels(_labels(spark, sf)).select("line_no", "geo_source", "geo_destination")


@query("t8_inbound_denied_score", over("select line_no, inbound_points as inbound_denied_score from ok"))
def _(spark, sf):
    return threat.inbound_denied_score(_labels(spark, sf)).select("line_no", "inbound_denied_score")


@query("t9_score_threats", over("select line_no, threat_detected, threat_type, mitre_technique_id, risk_score, geo_source, geo_destination from ok"))
def _(spark, sf):
    intel = threat.score_threats(_texts(spark, sf)).select("line_no", "threat_intel.*")
    return intel.drop("indicators")


@query("t9b_indicators", over("""select line_no, concat_ws(',', case action when 'deny' then 'denied_traffic' when 'alert' then 'alert_triggered' end,
 case port_kind when 'C2Beaconing' then 'c2_port:' || cast(destination_port as string) when 'Reconnaissance' then 'port_zero_scan' when 'BruteForce' then 'denied_high_risk_port:' || cast(destination_port as string) end,
 case when egress then 'large_egress:' || cast(bytes_sent as string) end, case when inbound_points > 0 then 'external_to_internal_denied' end) as indicators from ok"""))
def _(spark, sf):
    return src.events(spark, sf).select("line_no", F.array_join("threat_intel.indicators", ",").alias("indicators"))


@query("t10_technique_id", over("select line_no, mitre_technique_id from ok"))
def _(spark, sf):
    return threat.technique_id(_labels(spark, sf)).select("line_no", "mitre_technique_id")


# ---- validation and routing -------------------------------------------------------------

_FAULTY = """select event_id,
 case when event_id % 23 = 0 then '' else 'evt_' || cast(event_id as string) end as id, case when event_id % 19 = 0 then ' ' else msg end as raw,
 case when event_id % 29 = 0 then null else ts end as t, src_port + case when event_id % 7 = 0 then 65536 else 0 end as sp, cast(dst_port as bigint) - case when event_id % 17 = 0 then 70000 else 0 end as dp,
 case when event_id % 13 = 0 then 'x' || src_ip else src_ip end as sip, dst_ip as dip, case when event_id % 11 = 0 then 'severe' else 'low' end as sev,
 case when event_id % 31 = 0 then 1.5e0 else 0.5e0 end as conf, case when event_id % 37 = 0 then '' else '1.0' end as ver, cast((event_id % 17) * 10 as integer) as risk,
 case when event_id % 41 = 0 then -5 else bytes_sent end as sent, cast(case when event_id % 43 = 0 then -1 else 0 end as bigint) as recv from base"""
_REASONS = {
    "required": "case when id = '' then 'Missing event_id' when trim(raw) = '' then 'Lossless violation: raw_event must never be empty' when t is null then 'Missing timestamp' end",
    "ports": "case when sp not between 0 and 65535 then 'Invalid source port: ' || cast(sp as string) when dp not between 0 and 65535 then 'Invalid destination port: ' || cast(dp as string) end",
    "ips": "case when sip like 'x%' then 'Malformed source IP: ' || sip end",
    "severity": "case when sev = 'severe' then 'Invalid severity ''severe''; must be one of critical, high, medium, low, informational' end",
    "confidence": "case when conf > 1 then 'Confidence 1.5 out of range [0.0, 1.0]' end",
    "schema_version": "case when ver = '' then 'Missing schema_version in metadata' end",
    "risk": "case when risk > 100 then 'Risk score ' || cast(risk as string) || ' out of range [0, 100]' end",
    "bytes": "case when sent < 0 then 'Negative bytes_sent: ' || cast(sent as string) when recv < 0 then 'Negative bytes_received: ' || cast(recv as string) end",
}
_FAULTY_COLS = {
    "event_id": "id", "raw_event": "raw", "timestamp": "t", "source_port": "sp", "destination_port": "dp", "source_ip": "sip",
    "destination_ip": "dip", "severity": "sev", "confidence": "conf", "schema_version": "ver", "risk_score": "risk",
    "bytes_sent": "sent", "bytes_received": "recv",
}


def _faulty(spark, sf) -> DataFrame:
    select = _FAULTY.strip().removeprefix("select").rsplit("from base", 1)[0]
    return src.truth(spark, sf).selectExpr(*fx._split_top_level(select))


def _rule(check):
    return lambda spark, sf: check(_faulty(spark, sf), _FAULTY_COLS).select("event_id", "reason")


for _id, _name, _check in [
    ("v1_check_required", "required", validate.check_required), ("v2_check_ports", "ports", validate.check_ports),
    ("v3_check_ips", "ips", validate.check_ips), ("v4_check_severity", "severity", validate.check_severity),
    ("v5_check_confidence", "confidence", validate.check_confidence),
    ("v6_check_schema_version", "schema_version", validate.check_schema_version),
    ("v7_check_risk", "risk", validate.check_risk), ("v8_check_bytes", "bytes", validate.check_bytes),
]:
    query(_id, over_truth(f"select event_id, {_REASONS[_name]} as reason from ({_FAULTY})"))(_rule(_check))

query("v9_validate", over_truth(f"select event_id, coalesce({', '.join(_REASONS.values())}) as reason from ({_FAULTY})"))(_rule(validate.validate))


@query("r1_route", over("select outcome, format, n from (select 'event' as outcome, format, count(*) as n from ok group by format union all select 'failed', detected_format, count(*) from bad group by detected_format)"))
def _(spark, sf):
    e, q = pr.route(src.processed(spark, sf))
    ok = e.groupBy(c("metadata.source_format").alias("format")).agg(F.count("*").alias("n")).withColumn("outcome", F.lit("event"))
    bad = q.groupBy(c("detected_format").alias("format")).agg(F.count("*").alias("n")).withColumn("outcome", F.lit("failed"))
    return ok.unionByName(bad)


@query("r1b_write_outcomes", over("select outcome, count(*) as n from exp group by outcome"))
def _(spark, sf):
    path = scratch_path(spark, "outcomes")
    writers.write_outcomes(src.processed_live(spark, sf), path)
    e, q = writers.read_outcomes(spark, path)
    return e.agg(F.count("*").alias("n")).withColumn("outcome", F.lit("event")).unionByName(
        q.agg(F.count("*").alias("n")).withColumn("outcome", F.lit("failed")))


@query("r2_quarantine_reason", _QUARANTINE)
def _(spark, sf):
    return pr.quarantine_reason(src.processed(spark, sf)).drop("event_id", "timestamp")


@query("s3b_explode_process", f"{_PIECES} select count(*) as n, count(*) as n_ids, count(distinct doc_id) as n_texts from p where trim(piece, {_WS}) <> ''")
def _(spark, sf):
    lines = text_lines.explode_lines(src.table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")
    rows = pr.process(lines, ingest_ts=fx.INGEST_TS, ref_year=fx.REF_YEAR)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"), F.count_distinct("file_path").alias("n_texts"))


def _hostile(spark, sf) -> DataFrame:
    texts = [("documents", "text"), ("conversations", "text"), ("pages", "html")]
    rows = [src.table(spark, sf, t).select(F.lit(t).alias("file_path"), c(col).alias("text")) for t, col in texts]
    return text_lines.explode_lines(rows[0].unionByName(rows[1]).unionByName(rows[2]), "text")


_HOSTILE_PIECES = (
    "with p as (select f, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')) as piece from "
    "(select 'documents' as f, text from documents union all select 'conversations', text from conversations union all select 'pages', html from pages))"
)


@query("r3_fault_isolation", f"{_HOSTILE_PIECES} select f as file_path, count(*) as n from p where trim(piece, {_WS}) <> '' group by f")
def _(spark, sf):
    done = pr.process(_hostile(spark, sf), ingest_ts=fx.INGEST_TS, ref_year=fx.REF_YEAR, headers=None)
    return done.groupBy("file_path").agg(F.count("outcome").alias("n"))


_CUT_LINES = [
    "CEF:0|Acme|Gate Firewall|1.0|7|Flow|3|src=10.0.0.1 dst=10.0.0.2 act=deny", "LEEF:1.0|Acme|Gate|7|login|src=10.0.0.1",
    "LEEF:2.0|Acme|Gate|7|login|^|src=10.0.0.1^act=deny", '{"src_ip":"10.0.0.1","action":"deny","n":{"a":[1,2]}}',
    "<134>1 2026-03-01T14:00:00Z gw app 7 ID9 [x@1 a=1] text", "<13>Feb  9 01:02:03 host9 cron[42]: job done",
    "devname=FG7 srcip=10.1.1.1 dstip=172.16.3.4 action=blocked", "2026-03-01T12:00:00Z,10.0.0.1,10.0.0.2,allow,low", "see CEF:0 in text", "CEF:0|bad",
]
_FORCED = [None, *[p[0] for p in vocab.PARSERS]]


@query("r3b_cut_lines", f"""with l(k, whole) as (values {", ".join(f"({k}, '{text}')" for k, text in enumerate(_CUT_LINES))}),
 p(j, parser) as (values {", ".join(f"({j}, {repr(name) if name else 'null'})" for j, name in enumerate(_FORCED))})
 select k, parser, count(*) as n, count(*) filter (k in (0, 9) and parser is null and least(length(whole), event_id % 70 + 6) < 50) as n_bad_cef
 from events join l on k = event_id % {len(_CUT_LINES)} join p on j = (event_id // {len(_CUT_LINES)}) % {len(_FORCED)} group by k, parser""")
def _(spark, sf):
    at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)
    k = c("event_id") % len(_CUT_LINES)
    lines = src.table(spark, sf, "events").select(
        k.alias("k"), at(_FORCED, F.expr(f"event_id div {len(_CUT_LINES)}") % len(_FORCED)).alias("parser_given"),
        F.substr(at(_CUT_LINES, k), F.lit(1), (c("event_id") % 70 + 6).cast("int")).alias("line"),
        F.concat(F.lit("f"), k).alias("file_path"), c("event_id").alias("line_no"))
    done = pr.process(lines, forced_parser=c("parser_given"), ingest_ts=fx.INGEST_TS, ref_year=fx.REF_YEAR, headers=None)
    ran = done.select("file_path", "line_no", "outcome", "detected_format")
    back = lines.select("k", c("parser_given").alias("parser"), "file_path", "line_no")
    bad = (c("outcome") == "failed") & (c("detected_format") == "CEF") & c("k").isin(0, 9) & c("parser").isNull()
    return back.join(ran, ["file_path", "line_no"]).groupBy("k", "parser").agg(F.count("outcome").alias("n"), F.count_if(bad).alias("n_bad_cef"))


@query("r4_process", over(_EVENT))
def _(spark, sf):
    return _event_columns(pr.events_of(src.processed_live(spark, sf)))


# ---- search -----------------------------------------------------------------------------

T_COLUMNS = ["event_id", "timestamp", "source_vendor", "source_device_type", "source_ip", "destination_ip", "protocol", "action", "severity", "risk_score"]
_T = "select 'evt_' || cast(line_no as string) as event_id, timestamp, vendor as source_vendor, device_type as source_device_type, source_ip, destination_ip, protocol, action, severity, risk_score from ok"


def _t(fn):
    return lambda spark, sf: fn(src.flat(spark, sf)).select(*T_COLUMNS)


query("f1_search", over(f"{_T} where threat_type = 'BruteForce' or (tpl in (0, 1, 4, 5, 7, 8, 10) and msg like '%port s_an%')"))(
    lambda spark, sf: search.search(src.flat(spark, sf), "BRUTEFORCE").unionByName(
        search.search(src.flat(spark, sf), "port s_an").filter(F.coalesce(c("threat_type"), F.lit("")) != "BruteForce")).select(*T_COLUMNS))
query("f2_by_ip", over(f"{_T} where destination_ip = '198.51.100.27' or destination_ip = '192.168.1.2'"))(
    lambda spark, sf: search.by_ip(src.flat(spark, sf), destination_ip=" 198.51.100.27 ").unionByName(
        search.by_ip(src.flat(spark, sf), destination_ip="192.168.1.2")).select(*T_COLUMNS))


def _lookup(spark, sf) -> DataFrame:
    """T, laid out for look-ups."""
    def make():
        path = scratch_path(spark, "lookup")
        writers.write_lookup(src.events(spark, sf), path)
        return path

    return tables.read_events(spark, src.once(spark, sf, "lookup", make))


query("f2b_lookup_by_ip", over(f"{_T} where destination_ip = '198.51.100.27' or source_ip = '203.0.113.9'"))(
    lambda spark, sf: search.by_ip(_lookup(spark, sf), destination_ip="198.51.100.27").unionByName(
        search.by_ip(_lookup(spark, sf), source_ip="203.0.113.9").filter("destination_ip is null or destination_ip <> '198.51.100.27'")).select(*T_COLUMNS))
query("f5b_lookup_by_id", over(f"{_T} where line_no in (42, 43)"))(
    lambda spark, sf: search.event_by_id(_lookup(spark, sf), "evt_42").unionByName(search.event_by_id(_lookup(spark, sf), "evt_43")).select(*T_COLUMNS))
query("f3_by_label", over(f"{_T} where protocol = 'UDP' and action = 'deny' and vendor = 'Acme'"))(
    _t(lambda t: search.by_label(t, protocol="udp", action=" DENY ", vendor="ACME")))
query("f4_filter_events", over(f"{_T} where severity = 'informational' and device_type = 'ids' and action = 'alert'"))(
    _t(lambda t: search.filter_events(t, severity="Informational", device_type="IDS", action="alert", canonical=True)))
query("f5_event_by_id", over(f"{_T} where line_no = 42"))(_t(lambda t: search.event_by_id(t, "evt_42")))
query("f6_non_empty", over(f"{_T} where source_ip is not null"))(_t(lambda t: search.non_empty(t, "source_ip")))

query("o1_page", over(f"{_T} order by timestamp desc, event_id limit 50 offset 100"))(_t(lambda t: search.page(t, 3, 50)))
query("o1b_page_after", over(f"select * from ({_T}) where timestamp < timestamp '2024-01-15 00:00:00' order by timestamp desc, event_id limit 50"))(
    _t(lambda t: search.page_after(t, "2024-01-15 00:00:00", "evt_999999999", 50)))


def _runs(spark, sf) -> str:
    """T in runs of pages."""
    def make():
        path = scratch_path(spark, "page-runs")
        page_runs.write_runs(src.flat(spark, sf), path, rows=200)
        return path

    return src.once(spark, sf, "page-runs", make)


_BY_RUNS = f"({_T} order by timestamp desc, event_id limit 50 offset 100)", f"({_T} order by timestamp desc, event_id limit 50 offset 700)"
query("o1c_page_of_runs", over(f"select * from {_BY_RUNS[0]} union all select * from {_BY_RUNS[1]}"))(
    lambda spark, sf: page_runs.page_of_runs(spark, _runs(spark, sf), 3, 50).unionByName(
        page_runs.page_of_runs(spark, _runs(spark, sf), 15, 50)).select(*T_COLUMNS))
query("o2b_page_info_of_runs", over("select count(*) as total, cast(ceil(count(*) / 50.0) as bigint) as total_pages from ok"))(
    lambda spark, sf: page_runs.page_info_of_runs(spark, _runs(spark, sf), 50))
query("o2_page_info", over("select count(*) as total, cast(ceil(count(*) / 50.0) as bigint) as total_pages from ok where action = 'deny'"))(
    lambda spark, sf: search.page_info(search.filter_events(src.flat(spark, sf), action="deny"), 50))


def _top_sql(col: str, k: int) -> str:
    return over(f"select {col} as key, count(*) as count from ok where {col} is not null group by {col} order by count desc, key limit {k}")


query("o3_top_k", _top_sql("type", 5))(
    lambda spark, sf: search.top_k(src.events(spark, sf).select("event.type"), "type", 5))
query("o4_latest_failed", over("select 'fail_' || cast(line_no as string) as event_id, reason from bad order by event_id limit 100"))(
    lambda spark, sf: search.latest_failed(src.quarantine(spark, sf), 100).select("event_id", "reason"))
query("o5_latest_batches", over("select 'batch_' || cast(user_id as string) as batch_id, count(*) as total_events, max(ts) as created_at from exp group by user_id order by created_at desc, batch_id limit 5"))(
    lambda spark, sf: search.latest_batches(src.batches(spark, sf)).select("batch_id", "total_events", "created_at"))
query("o6_latest_events", over(f"{_T}"))(_t(search.latest_events))


# ---- aggregates -------------------------------------------------------------------------

def _on_flat(fn):
    return lambda spark, sf: fn(src.flat(spark, sf))


def _count_sql(expr: str, k: int | None = None) -> str:
    tail = "" if k is None else f" order by count desc, key limit {k}"
    return over(f"select {expr} as key, count(*) as count from ok group by 1{tail}")


query("a1_totals", over("select count(*) filter (outcome = 'event') as total_events, count(*) filter (outcome = 'failed') as failed_events from exp"))(
    lambda spark, sf: an.totals(src.flat(spark, sf), src.quarantine(spark, sf)))
query("a2_top_source_ips", _top_sql("source_ip", 7))(_on_flat(lambda t: search.top_k(t, "source_ip", 7)))
query("a3_top_destination_ips", _top_sql("destination_ip", 7))(_on_flat(lambda t: search.top_k(t, "destination_ip", 7)))
query("a4_protocol_breakdown", _count_sql("upper(coalesce(protocol, 'OTHER'))", 6))(_on_flat(an.protocol_breakdown))
query("a5_action_breakdown", _count_sql("action"))(_on_flat(an.action_breakdown))
query("a6_severity_breakdown", _count_sql("severity"))(_on_flat(an.severity_breakdown))
query("a7_device_breakdown", _count_sql("device_type"))(_on_flat(an.device_breakdown))
query("a8_active_sources", over("select count(distinct device_type) as n from ok"))(_on_flat(an.active_sources))
query("a9_threat_count", over("select count(*) as n from ok where threat_detected"))(_on_flat(an.threat_count))
query("a10_threat_types", _top_sql("threat_type", 10))(_on_flat(an.threat_types))
query("a11_mean_threat_risk", over("select round(avg(risk_score), 1) as avg_risk from ok where threat_detected"))(_on_flat(an.mean_threat_risk))
query("a12_category_breakdown", _count_sql("category"))(_on_flat(an.category_breakdown))
query("a13_vendor_breakdown", _count_sql("vendor", 10))(_on_flat(an.vendor_breakdown))


def _metric_sql(metric: str, expr: str, k: int | None = None, where: str = "") -> str:
    tail = "" if k is None else f" order by count desc, key limit {k}"
    return f"select * from (select '{metric}' as metric, {expr} as key, count(*) as count from ok {where} group by {expr}{tail})"


query("a14_analytics", over(" union all ".join([
    "select 'total_events' as metric, cast(null as string) as key, count(*) as count from ok",
    "select 'failed_events', null, count(*) from bad",
    "select 'threats', null, count(*) from ok where threat_detected",
    "select 'risk_total', null, cast(sum(risk_score) as bigint) from ok where threat_detected",
    _metric_sql("source_ip", "source_ip", 7, "where source_ip is not null"),
    _metric_sql("destination_ip", "destination_ip", 7, "where destination_ip is not null"),
    _metric_sql("protocol", "upper(coalesce(protocol, 'OTHER'))", 6), _metric_sql("action", "action"),
    _metric_sql("severity", "severity"), _metric_sql("device_type", "device_type"), _metric_sql("category", "category"),
    _metric_sql("vendor", "vendor", 10), _metric_sql("threat_type", "threat_type", 10, "where threat_type is not null"),
])))(lambda spark, sf: an.analytics(src.flat(spark, sf), src.quarantine(spark, sf)))


query("a14b_dashboard", over(" union all ".join([
    "select 'total_events' as metric, cast(null as string) as key, cast(count(*) as double) as value from ok",
    "select 'failed_events', null, count(*) from bad",
    "select 'threats', null, count(*) from ok where threat_detected",
    "select 'risk_total', null, sum(risk_score) from ok where threat_detected",
    "select 'active_sources', null, count(distinct device_type) from ok",
    "select 'average_risk_score', null, round(avg(risk_score), 1) from ok where threat_detected",
    "select * from (select 'recent_batch', 'batch_' || cast(user_id as string) as batch_id, count(*) from exp group by user_id order by max(ts) desc, batch_id limit 5)",
    _metric_sql("source_ip", "source_ip", 7, "where source_ip is not null"),
    _metric_sql("destination_ip", "destination_ip", 7, "where destination_ip is not null"),
    _metric_sql("protocol", "upper(coalesce(protocol, 'OTHER'))", 6), _metric_sql("action", "action"),
    _metric_sql("severity", "severity"), _metric_sql("device_type", "device_type"), _metric_sql("category", "category"),
    _metric_sql("vendor", "vendor", 10), _metric_sql("threat_type", "threat_type", 10, "where threat_type is not null"),
])))(lambda spark, sf: an.dashboard(src.flat(spark, sf), src.quarantine(spark, sf), src.batches(spark, sf)))


def _rolled_up(spark, sf) -> DataFrame:
    """T and Q in three batches, one of them run twice, as daily figures."""
    def make():
        path = scratch_path(spark, "rollup")
        t, q, part = src.flat(spark, sf), src.quarantine(spark, sf), F.pmod(F.xxhash64("event_id"), F.lit(3))
        for number in (0, 1, 2, 1):
            rollups.write_batch(t.filter(part == number), q.filter(part == number), path, f"b{number}")
        return path

    return rollups.read_figures(spark, src.once(spark, sf, "rollup", make))


query("a14c_dashboard_of_rollups", ORACLES["a14b_dashboard"])(
    lambda spark, sf: an.dashboard_of(an.analytics_of(_rolled_up(spark, sf)), src.batches(spark, sf)))


@query("a15_batch_summary", over("select count(*) as total_events, count(*) filter (outcome = 'event') as normalized_count, count(*) filter (outcome = 'failed') as failed_count from exp"))
def _(spark, sf):
    return an.batch_summary(src.events(spark, sf), src.quarantine(spark, sf), 1.0).select(
        "total_events", "normalized_count", "failed_count")


def _exploded(df: DataFrame, *maps: str) -> DataFrame:
    parts = [df.select(F.lit(m).alias("breakdown"), F.explode(m).alias("key", "count")) for m in maps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("a16_batch_breakdowns", over("""select 'sources_breakdown' as breakdown, device_type as key, count(*) as count from ok group by device_type
 union all select 'formats_breakdown', format, count(*) from ok group by format union all select 'actions_breakdown', action, count(*) from ok group by action"""))
def _(spark, sf):
    return _exploded(an.batch_breakdowns(src.events(spark, sf)), "sources_breakdown", "formats_breakdown", "actions_breakdown")


@query("a16b_breakdown_rows", over("""select 'sources_breakdown' as name, device_type as key, count(*) as n from ok group by device_type
 union all select 'formats_breakdown', format, count(*) from ok group by format union all select 'actions_breakdown', action, count(*) from ok group by action"""))
def _(spark, sf):
    return an.breakdown_rows(src.events(spark, sf))


@query("a17_batch_risk", over("select severity as key, count(*) as count, (select count(*) from ok where threat_detected) as threat_count from ok group by severity"))
def _(spark, sf):
    return an.batch_risk(src.events(spark, sf)).select("threat_count", F.explode("severity_breakdown").alias("key", "count"))


@query("a18_with_share", over("select action as key, count(*) as count, cast(floor(count(*) * 100 / (select count(*) from ok) + 0.5) as integer) as pct from ok group by action"))
def _(spark, sf):
    return an.with_share(an.action_breakdown(src.flat(spark, sf)))


# ---- asked for by the specification -----------------------------------------------------

@query("x1_event_frequency", over("select date_trunc('hour', timestamp) as window_start, count(*) as n from ok group by 1"))
def _(spark, sf):
    return an.event_frequency(src.flat(spark, sf), "1 hour")


@query("x2_error_rate", over("select key, count(*) as total, count(*) filter (failed) as failed, round(count(*) filter (failed) / count(*), 6) as error_rate from (select format as key, false as failed from ok union all select detected_format, true from bad) group by key"))
def _(spark, sf):
    return an.error_rate(src.processed(spark, sf)).withColumn("error_rate", F.round("error_rate", 6))


@query("x3_parser_performance", over("select parser, count(*) as total, count(*) filter (failed) as failed, round(avg(confidence), 4) as mean_confidence from (select parser, false as failed, confidence from ok union all select parser_attempted, true, 0.99 from bad where parser_attempted is not null) group by parser"))
def _(spark, sf):
    return an.parser_performance(src.processed(spark, sf))


query("x4_date_range_sorted", over(f"select * from ({_T}) where timestamp >= timestamp '2024-01-10 00:00:00' and timestamp < timestamp '2024-01-12 00:00:00' order by risk_score desc, event_id limit 50"))(
    _t(lambda t: search.page(search.filter_events(t, since="2024-01-10 00:00:00", until="2024-01-12 00:00:00"), order_by="risk_score")))
query("x5_quarantine_line_no", over("select line_no, file_path, reason from bad"))(
    lambda spark, sf: src.quarantine(spark, sf).select("line_no", "file_path", "reason"))


@query("x6_onboard_source", over_truth("select event_id, 'ExampleVendor' as vendor, 'firewall' as device_type, src_ip as source_ip, dst_ip as destination_ip, cast(dst_port as integer) as destination_port, case when event_type in ('click', 'view') then 'allow' when event_type in ('purchase', 'signup') then 'deny' else 'alert' end as action from base"))
def _(spark, sf):
    rows = src.truth(spark, sf).select("event_id", F.expr("concat('n', user_id)").alias("file_path"), c("event_id").alias("line_no"), F.expr(
        "format_string('from_host=%s to_host=%s to_port=%s verdict=%s', src_ip, dst_ip, dst_port, action_raw)").alias("line"))
    config = spark.createDataFrame(
        [("example-firewall", "ExampleVendor", "firewall", "keyvalue-network-v1", {"from_host": "src", "to_host": "dst", "to_port": "dport", "verdict": "action"})],
        "name string, vendor string, device_type string, parser string, field_mapping map<string,string>")
    done = pr.onboard_source(rows.drop("event_id"), config, fx.INGEST_TS, fx.REF_YEAR)
    return done.select(c("line_no").alias("event_id"), "source.vendor", "source.device_type", "network.source_ip",
                       "network.destination_ip", "network.destination_port", "event.action")


@query("x6b_onboard_sources", over_truth("select event_id, 'V' || cast(user_id as string) as vendor, case when user_id % 2 = 0 then 'firewall' else 'vpn' end as device_type, src_ip as source_ip, dst_ip as destination_ip, cast(dst_port as integer) as destination_port, case when event_type in ('click', 'view') then 'allow' when event_type in ('purchase', 'signup') then 'deny' else 'alert' end as action from base"))
def _(spark, sf):
    """Every user a source with field names of its own."""
    truth = src.truth(spark, sf)
    user = c("user_id").cast("string")
    config = truth.select("user_id").distinct().select(
        F.concat(F.lit("s"), user).alias("name"), F.concat(F.lit("V"), user).alias("vendor"),
        F.when(c("user_id") % 2 == 0, "firewall").otherwise("vpn").alias("device_type"), F.lit("keyvalue-network-v1").alias("parser"),
        F.create_map(F.concat(F.lit("From"), user), F.lit("src"), F.lit("to_host"), F.lit("dst"), F.concat(F.lit("p"), user), F.lit("dport"), F.lit("verdict"), F.lit("action")).alias("field_mapping"))
    rows = truth.select(F.concat(F.lit("s"), user).alias("origin"), F.lit("one").alias("file_path"), c("event_id").alias("line_no"), F.expr(
        "format_string('from%s=%s to_host=%s p%s=%s verdict=%s', user_id, src_ip, dst_ip, user_id, dst_port, action_raw)").alias("line"))
    done = pr.onboard_sources(rows, config, "origin", fx.INGEST_TS, fx.REF_YEAR)
    return done.select(c("line_no").alias("event_id"), "source.vendor", "source.device_type", "network.source_ip",
                       "network.destination_ip", "network.destination_port", "event.action")


@query("x7_export_parquet", over("select cast(timestamp as date) as event_date, count(*) as n from ok group by 1"))
def _(spark, sf):
    path = scratch_path(spark, "parquet")
    writers.export_parquet(src.events(spark, sf), path)
    return spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("n"))


@query("x8_audit_trail", over("select 'evt_' || cast(line_no as string) as event_id, parser, format as source_format, confidence, '1.0' as schema_version from ok"))
def _(spark, sf):
    return an.audit_trail(src.events(spark, sf)).drop("processed_at", "raw_event")


@query("x8b_processing_report", over("select count(distinct user_id) as batches, count(*) as total_events, count(*) filter (outcome = 'event') as normalized_count, count(*) filter (outcome = 'failed') as failed_count, count(distinct user_id) * 2.0 as processing_time_seconds from exp"))
def _(spark, sf):
    return an.processing_report(src.batches(spark, sf))


# ---- streams ----------------------------------------------------------------------------

def _event_stream(spark, sf) -> DataFrame:
    """The events table as a file stream, rendered to lines."""
    schema = src.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return fx.render(fx.step1_of(rows))


def _finished(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all there is into a table, and read that."""
    out, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("s7_stream_log_lines", over_truth("select count(*) as n, count(distinct event_id) filter (is_bad = 1 and tpl % 2 = 1) as n_notes from base"))
def _(spark, sf):
    rows = _finished(spark, text_lines.stream_log_lines(spark, src.text_files(spark, sf)), "lines")
    note = F.when(c("line").startswith("console note"), c("line"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct(note).alias("n_notes"))


@query("s7b_stream_lines_process", over_truth("select count(*) as n, count(*) as n_ids from base"))
def _(spark, sf):
    from logmeld.streaming.streams import stream_process

    out, log = scratch_path(spark, "stream"), scratch_path(spark, "stream-log")
    lines = text_lines.stream_log_lines(tune(spark), src.text_files(spark, sf))
    stream_process(lines, out, log, fx.INGEST_TS, ref_year=fx.REF_YEAR).awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("x9_stream_process", over(_EVENT))
def _(spark, sf):
    from logmeld.streaming.streams import stream_process

    out, log = scratch_path(spark, "stream"), scratch_path(spark, "stream-log")
    lines = _event_stream(tune(spark), sf).select("line", "file_path", "line_no")
    names = fx.CSV_HEADER.split(",")
    stream_process(lines, out, log, fx.INGEST_TS, ref_year=fx.REF_YEAR, headers=names).awaitTermination()
    return _event_columns(pr.events_of(spark.read.parquet(out)))


def _ground_stream(spark, sf) -> DataFrame:
    schema = src.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.select(c("ts").cast("timestamp").alias("timestamp"), c("event_id").cast("string").alias("event_id"), c("event_type").alias("kind"),
                       F.struct(F.concat(F.lit("u"), "user_id").alias("source_ip")).alias("network"))


@query("x10_stream_counts", "select time_bucket(interval 1 hour, ts) as window_start, event_type as key, count(*) as n from events where time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) - interval 10 minute from events) group by 1, 2")
def _(spark, sf):
    from logmeld.streaming.streams import stream_counts

    return _finished(spark, stream_counts(_ground_stream(spark, sf), key="kind"), "counts")


_SESSIONS = """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as starts from events),
 n as (select *, sum(starts) over (partition by user_id order by ts rows between unbounded preceding and current row) as session from g)
select min(ts) as session_start, max(ts) + interval 30 minute as session_end, 'u' || cast(user_id as string) as source_ip, count(*) as n from n group by user_id, session
having max(ts) + interval 30 minute <= (select max(ts) - interval 10 minute from events)"""


@query("x10b_stream_sessions", _SESSIONS)
def _(spark, sf):
    from logmeld.streaming.streams import stream_sessions

    return _finished(spark, stream_sessions(_ground_stream(spark, sf)), "sessions")


@query("x10c_sessions", _SESSIONS[: _SESSIONS.index("having")])
def _(spark, sf):
    from logmeld.operators.sessions import sessions

    rows = src.table(spark, sf, "events").select(c("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("u"), "user_id").alias("source_ip"))
    return sessions(rows, 1800, "source_ip")


@query("x11_stream_dedup", "select cast(event_id as string) as event_id, event_type as kind from events")
def _(spark, sf):
    from logmeld.streaming.streams import stream_dedup

    twice = _ground_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _finished(spark, stream_dedup(twice), "dedup").select("event_id", "kind")
