"""One literal line per branch, through the whole of ``process``."""

import pytest

from logmeld.plans.process import process

LINES = {
    "rfc5424": "<14>1 2026-03-01T14:00:00Z gw1 traffic - - - src=10.0.0.5 dst=8.8.8.8 sport=53200 dport=443 proto=tcp action=allow",
    "rfc5424_sd": '<165>1 2026-03-01T14:00:00.5+02:00 - app 77 ID9 [x@1 user="ann" severity="3"] hello',
    "rfc5424_spaces": "<14>1  2026-03-01T14:00:00Z   gw1 traffic - - -   plain words",
    "rfc3164": "<13>Feb  9 01:02:03 host9 cron[42]: job done",
    "rfc3164_year": "Feb 9 01:02:03 2023 host9 note",
    "pri_only": "<11> bare message user=bob",
    "asa": "%ASA-4-106023: Deny tcp src outside:198.51.100.5/45678 dst inside:10.0.0.25/80 by access-group x",
    "asa_built": "<166>Feb  9 01:02:03 edge : %ASA-6-302013: Built outbound TCP connection 9 for outside:8.8.8.8/53",
    "kv": 'devname=FG7 srcip=10.1.1.1 dstip=172.16.3.4 dstport=22 action=blocked proto=17 msg="two words" sentbyte=20000000',
    "kv_plain": "a=1 b=2 c=3",
    "cef": r"CEF:0|Acme|Gate IDS|1|7|Scan|9|src=10.0.0.1 msg=many words a\=b suser=x act=Drop act=permit rt=1709251200000",
    "cef_prefix": "<13>Feb 9 01:02:03 relay CEF:1|V|Proxy box|1|7|n|2|cs1=a  b dst=10.2.2.2",
    "cef_short": "CEF:0|only|two",
    "leef_tab": "LEEF:1.0|V|VPN one|7|login|\tsrc=172.16.0.2\tdst=10.10.10.10\tdpt=70000\tact=allow",
    "leef_caret": "LEEF:2.0|V|P|7|9|^|src=10.0.0.1^act=deny",
    "leef_hex": "LEEF:2.0|V|P|7|9|0x2c|src=10.0.0.2,act=deny",
    "leef_bad": "LEEF:3.0|V|P",
    "json": '{"timestamp":"2026-03-01T14:00:00Z","src_ip":"192.168.1.2","dest_ip":"1.1.1.1","src_port":5,"dest_port":53,"proto":"udp","action":"allow"}',
    "json_suricata": '{"event_type":"alert","src_ip":"45.1.1.1","alert":{"signature":"Port Scan","severity":1,"category":"attempt"},"message":null}',
    "json_zeek": '{"uid":"C1","id":{"orig_h":"10.0.0.1","orig_p":1,"resp_h":"10.0.0.2","resp_p":4444},"proto":"tcp"}',
    "json_nested": '{"user":{"name":"x"},"hostname":"h","time":"20:00"}',
    "json_repeated": '{"action":"allow","action":"deny","host":"h"}',
    "json_trailing": '{"action":"allow"}{"a":1}',
    "json_broken": "{not_json: true}",
    "csv_header": "timestamp,src_ip,dst_ip,action,user",
    "csv_row": '2026-03-01 10:00:00,10.0.0.9,10.0.0.8,"permit",o\'neil',
    "csv_other_width": "2026-03-01 10:00:00,1.5,x,y",
    "gibberish": "no structure at all !@#$",
    "blank": " \t ",
    "negative_bytes": "src=10.0.0.1 dst=10.0.0.2 action=allow bytes_sent=-5",
    "spaces": "  src=10.0.0.1 dst=10.0.0.2 action=allow  ",
}


@pytest.fixture(scope="module")
def rows(spark):
    names = list(LINES)
    data = [(LINES[n], "one.log", i) for i, n in enumerate(names)]
    df = spark.createDataFrame(data, "line string, file_path string, line_no long")
    done = process(df, ingest_ts="2026-06-01 00:00:00", ref_year=2026)
    return {names[r.line_no]: r for r in done.collect()}


def test_blank_lines_are_skipped(rows):
    assert "blank" not in rows and len(rows) == len(LINES) - 1


@pytest.mark.parametrize("name, fmt, confidence", [
    ("rfc5424", "SYSLOG", 0.98), ("rfc3164", "SYSLOG", 0.95), ("pri_only", "SYSLOG", 0.85), ("asa", "KEY_VALUE", 0.98),
    ("kv", "KEY_VALUE", 0.95), ("kv_plain", "KEY_VALUE", 0.85), ("cef", "CEF", 0.99), ("leef_tab", "LEEF", 0.99),
    ("json", "JSON", 0.99), ("json_zeek", "JSON", 0.92), ("csv_row", "CSV", 0.85),
])
def test_detection(rows, name, fmt, confidence):
    assert (rows[name].metadata.source_format, rows[name].metadata.confidence) == (fmt, confidence)


def test_rfc5424(rows):
    e = rows["rfc5424"]
    assert (e.network.source_ip, e.network.destination_ip) == ("10.0.0.5", "8.8.8.8")
    assert (e.network.source_port, e.network.destination_port, e.network.protocol) == (53200, 443, "TCP")
    assert (e.event.action, e.event.severity, e.source.hostname, e.process.name) == ("allow", "informational", "gw1", "traffic")
    assert e.timestamp.isoformat() == "2026-03-01T14:00:00"
    assert rows["rfc5424_spaces"].source.hostname == "gw1"


def test_structured_data_overrides_header_fields(rows):
    e = rows["rfc5424_sd"]
    assert (e.user.name, e.event.severity, e.source.hostname, e.process.pid) == ("ann", "high", None, "77")
    assert e.timestamp.isoformat() == "2026-03-01T12:00:00.500000"


def test_rfc3164(rows):
    e = rows["rfc3164"]
    assert (e.source.hostname, e.process.name, e.process.pid, e.event.severity) == ("host9", "cron", "42", "low")
    assert e.timestamp.isoformat() == "2026-02-09T01:02:03"
    assert rows["rfc3164_year"].timestamp.year == 2023
    assert rows["pri_only"].user.name == "bob"


def test_cisco_asa(rows):
    e = rows["asa"]
    assert (e.source.vendor, e.event.action, e.network.source_port, e.network.destination_port) == ("Cisco", "deny", 45678, 80)
    assert rows["asa_built"].outcome == "event" and rows["asa_built"].network.source_ip is None
    assert rows["asa_built"].timestamp_source == "ingest"


def test_key_value(rows):
    e = rows["kv"]
    assert (e.source.vendor, e.network.protocol, e.event.action, e.network.bytes_sent) == ("Fortinet", "UDP", "deny", 20_000_000)
    assert e.threat_intel.threat_type == "BruteForce" and "large_egress:20000000" in e.threat_intel.indicators


def test_cef(rows):
    e = rows["cef"]
    assert (e.source.vendor, e.source.device_type, e.event.type) == ("Acme", "ids", "Scan")
    assert e.event.action == "allow"  # the last of two
    assert e.event.severity == "informational"  # 9 on the syslog scale
    assert e.timestamp.isoformat() == "2024-03-01T00:00:00"
    assert rows["cef_prefix"].source.device_type == "proxy"
    assert "does not conform to CEF format: CEF:0|only|two" in rows["cef_short"].reason


def test_leef(rows):
    e = rows["leef_tab"]
    assert (e.network.source_ip, e.network.destination_port, e.source.device_type) == ("172.16.0.2", None, "vpn")
    assert rows["leef_caret"].event.action == "deny"
    assert rows["leef_hex"].network.source_ip == "10.0.0.2"
    assert rows["leef_bad"].outcome == "failed" and rows["leef_bad"].parser_attempted == "leef-qradar-v1"


def test_json(rows):
    assert rows["json"].network.source_port == 5 and rows["json"].network.destination_port is None
    s = rows["json_suricata"]
    assert (s.source.vendor, s.event.type, s.event.severity, s.threat_intel.threat_type) == ("Suricata", "Port Scan", "critical", "PortScan")
    z = rows["json_zeek"]
    assert (z.source.vendor, z.network.destination_port, z.threat_intel.threat_type, z.user.name) == ("Zeek", 4444, "C2Beaconing", "C1")
    assert rows["json_nested"].user.name is None and rows["json_nested"].source.hostname == "h"
    assert rows["json_repeated"].event.action == "deny"
    assert rows["json_trailing"].outcome == rows["json_broken"].outcome == "failed"


def test_csv(rows):
    assert rows["csv_header"].outcome == "skipped"
    e = rows["csv_row"]
    assert (e.network.source_ip, e.event.action, e.user.name) == ("10.0.0.9", "allow", "o'neil")
    assert rows["csv_other_width"].outcome == "event" and rows["csv_other_width"].network.source_ip is None


def test_quarantine_and_raw(rows):
    assert rows["gibberish"].reason.startswith("No suitable parser detected (confidence=0.00; line_prefix='no structure")
    assert rows["negative_bytes"].reason == "Validation failed: Negative bytes_sent: -5"
    assert rows["spaces"].raw_event == LINES["spaces"].strip() and rows["spaces"].raw_line == LINES["spaces"]
    assert all(r.raw_event == LINES[n].strip() for n, r in rows.items())


def test_forced_parser(spark):
    df = spark.createDataFrame([("just words", "f", 1)], "line string, file_path string, line_no long")
    row = process(df, forced_parser="syslog-rfc3164-5424", headers=None).first()
    assert (row.outcome, row.metadata.confidence, row.metadata.source_format) == ("event", 1.0, "SYSLOG")
    row = process(df, forced_parser="nope", headers=None).first()
    assert (row.reason, row.detected_format, row.parser_attempted) == ("Specified parser 'nope' not found in registry", "unknown", None)


def test_lines_of_different_texts_keep_their_ids_and_headers_apart(spark):
    from logmeld.sources import text_lines

    header = "timestamp,src_ip,dst_ip,action,severity"
    row = "2026-03-01T12:00:00Z,10.0.0.1,10.0.0.2,allow,low"
    df = spark.createDataFrame([(1, f"{header}\n{row}\n{row}"), (2, row), (3, row)], "doc long, t string")
    got = process(text_lines.explode_lines(df, "t", "doc"), ingest_ts="2026-06-01 00:00:00").collect()
    assert len(got) == 5 and len({r.event_id for r in got}) == 5
    named = {r.file_path: r.network.source_ip for r in got if r.outcome != "skipped"}
    assert named["text/1"] == "10.0.0.1"


def test_stream_numbers_lines_and_carries_headers(spark, tmp_path):
    from logmeld.sources import text_lines
    from logmeld.streaming.streams import stream_process

    (tmp_path / "in").mkdir()
    row = "2026-03-01T12:00:00Z,10.0.0.1,10.0.0.2,allow,low"
    (tmp_path / "in" / "a.csv").write_text(f"timestamp,src_ip,dst_ip,action,severity\n{row}\n{row}\n")
    lines = text_lines.stream_log_lines(spark, str(tmp_path / "in"))
    stream_process(lines, str(tmp_path / "out"), str(tmp_path / "log"), "2026-06-01 00:00:00", batches=str(tmp_path / "batches")).awaitTermination()
    assert [(r.batch_id, r.total_events, r.normalized_count, r.failed_count) for r in spark.read.parquet(str(tmp_path / "batches")).collect()] == [("stream_0", 2, 2, 0)]
    events = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.outcome == "event"]
    assert [r.network.source_ip for r in events] == ["10.0.0.1"] * 2 and len({r.event_id for r in events}) == 2
    assert sorted(r.line_no for r in events) == [2, 3]


def test_upsert_leaves_one_row_a_key_and_other_dates_alone(spark, tmp_path):
    from logmeld.sources import writers

    path, schema = str(tmp_path / "t"), "id string, at int, v string, day string"
    put = lambda rows: writers.upsert(spark.createDataFrame(rows, schema), path, "id", "at", "day")
    put([("a", 1, "x", "d1"), ("b", 1, "y", "d2")])
    before = sorted((tmp_path / "t" / "day=d2").iterdir())
    put([("a", 2, "z", "d1"), ("c", 1, "w", "d1")])
    put([("a", 1, "old", "d1")])
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [("a", "z"), ("b", "y"), ("c", "w")]
    assert sorted((tmp_path / "t" / "day=d2").iterdir()) == before


def test_canonical_labels_and_whole_exports(spark):
    from logmeld.operators import search

    t = spark.createDataFrame([("e1", "IPv6-ICMP"), ("e2", "TCP")], "event_id string, protocol string")
    assert [r.event_id for r in search.filter_events(t, protocol="ipv6-icmp", canonical=True).collect()] == ["e1"]
    assert [r.event_id for r in search.filter_events(t, protocol="tcp", canonical=True).collect()] == ["e2"]
    assert search.latest_events(t).count() == 2


def test_field_mapping_reaches_the_event(spark):
    from logmeld.plans.process import onboard_source

    lines = spark.createDataFrame(
        [("from_host=10.0.0.1 toPort=443 verdict=deny to_host=10.0.0.9 proto=tcp", "f", 1), ('{"flow": {"src": "10.1.1.1", "deep": {"er": {"still": {"down": "10.2.2.2"}}}}, "toPort": 22}', "f", 2)],
        "line string, file_path string, line_no long")
    config = [
        ("kv", "V", "proxy", "keyvalue-network-v1", {"from_host": "source_ip", "to_host": "destination_ip", "toPort": "destination_port", "verdict": "action"}),
        ("js", "W", "ids", "json-universal-v1", {"flow.src": "source_ip", "flow.deep.er.still.down": "destination_ip", "TOPORT": "destination_port"}),
    ]
    table = spark.createDataFrame(config, "name string, vendor string, device_type string, parser string, field_mapping map<string,string>")
    a = onboard_source(lines.filter("line_no = 1"), table, "2026-06-01 00:00:00", source="kv").first()
    b = onboard_source(lines.filter("line_no = 2"), table, "2026-06-01 00:00:00", source="js").first()
    assert (a.network.source_ip, a.network.destination_ip, a.network.destination_port, a.event.action) == ("10.0.0.1", "10.0.0.9", 443, "deny")
    assert a.source.device_type == "proxy" and "proxy" in a.metadata.tags
    assert (b.network.source_ip, b.network.destination_ip, b.network.destination_port) == ("10.1.1.1", "10.2.2.2", 22)


def test_one_vendor_field_may_have_two_targets(spark):
    from logmeld.operators.normalize import map_fields

    df = spark.createDataFrame([({"A": "1", "b": "2"},)], "fields map<string,string>")
    mapping = spark.createDataFrame([("a", "x", 0), ("a", "y", 0), ("B", "y", 1)], "vendor_field string, universal_field string, priority int")
    assert map_fields(df, mapping).first().fields == {"x": "1", "y": "1"}


def test_flatten_knows_no_depth(spark):
    from logmeld.operators.json_object import flatten_json

    deep = '{"v": 1}'
    for k in range(10):
        deep = f'{{"k{k}": {deep}}}'
    df = spark.createDataFrame([(deep,)], "line string")
    assert flatten_json(df).first().fields == {"k9.k8.k7.k6.k5.k4.k3.k2.k1.k0.v": "1"}


def test_no_line_ends_the_job(spark):
    """Every prefix of every sample line, detected and under every forced parser."""
    from logmeld import vocab

    cut = [t[:n] for t in LINES.values() for n in range(1, len(t) + 1)]
    cut += ["CEF:0", "CEF:0|", "CEF:0|bad", "see CEF:0 in text", "CEF:|", "LEEF:", "LEEF:1.0|", "<1>", "<>", "{}", "{", ",,,,", "====", "a=b=c=d=", "\u0085", "|||||||"]
    rows = [(t, "f", i) for i, t in enumerate(cut)]
    lines = spark.createDataFrame(rows, "line string, file_path string, line_no long")
    blank = sum(not t.strip() for t in cut)
    for parser in [None, *[p[0] for p in vocab.PARSERS]]:
        done = process(lines, forced_parser=parser, ingest_ts="2026-06-01 00:00:00", ref_year=2026)
        assert done.select("outcome", "reason", "network", "event", "user", "process").toArrow().num_rows == len(cut) - blank


def test_own_parsers_take_lines_by_confidence_and_order(spark):
    from pyspark.sql import functions as F
    from logmeld.operators.detect import parser_catalog
    from logmeld.operators.registry import Parser

    pairs = lambda line: F.when(line.contains("from"), F.create_map(F.lit("src_ip"), F.regexp_extract(line, r"from (\S+)", 1)))
    own = [
        Parser("door-v1", "DOOR", lambda line: F.when(line.startswith("DOOR"), 0.9), pairs, "Doors", lambda line: F.lower(F.substring(line, 1, 4)),
               lambda line: F.when(line.contains("broken"), "ValueError: broken door")),
        Parser("door-v2", "DOOR2", lambda line: F.when(line.startswith("DOOR"), 0.9), pairs, "Later"),
        Parser("sure-v1", "SURE", lambda line: F.when(line.contains("CEF:0|"), 1.0), pairs),
        Parser("window-v1", "WINDOW", lambda line: F.when(line.contains("a=1 b=2 c=3"), 0.86), lambda line: F.create_map(F.lit("msg"), line)),
    ]
    given = ["DOOR open from 10.0.0.1", "DOOR broken from 10.0.0.2", "DOOR without fields", "a=1 b=2 c=3", LINES["cef"], "plain"]
    lines = spark.createDataFrame([(t, "f", i) for i, t in enumerate(given)], "line string, file_path string, line_no long")
    done = process(lines, ingest_ts="2026-06-01 00:00:00", headers=None, parsers=own)
    got = {r.line_no: r for r in done.collect()}
    assert (got[0].outcome, got[0].detected_format, got[0].network.source_ip, got[0].source.vendor, got[0].source.device_type) == ("event", "DOOR", "10.0.0.1", "Doors", "door")
    assert got[1].reason == "Parser 'door-v1' extraction error: ValueError: broken door"
    assert got[2].reason == "Parser 'door-v1' extraction error: ValueError: no fields"
    assert [got[i].detected_format for i in (3, 4, 5)] == ["WINDOW", "CEF", "unknown"]
    forced = process(lines.limit(1), forced_parser="door-v2", ingest_ts="2026-06-01 00:00:00", headers=None, parsers=own).first()
    assert (forced.detected_format, forced.metadata.confidence, forced.source.vendor) == ("DOOR2", 1.0, "Later")
    assert parser_catalog(spark, own).filter("parser like 'door%'").count() == 2
    with pytest.raises(ValueError):
        process(lines, parsers=[*own, Parser("json-universal-v1", "X", pairs, pairs)])


def test_thousands_of_sources_in_one_pass(spark):
    from logmeld.plans.process import onboard_source, onboard_sources

    schema = "name string, vendor string, device_type string, parser string, field_mapping map<string,string>"
    config = spark.createDataFrame(
        [(f"s{i}", f"V{i}", None if i % 2 else "proxy", "keyvalue-network-v1", {f"a{i}": "source_ip", f"A{i}": "destination_ip"} if i else None) for i in range(5000)], schema)
    given = [(f"a{i}=10.0.{i // 250}.{i % 250} b=2 c=3", f"s{i}", i) for i in (0, 1, 2, 4999)] + [("src=10.0.0.1 dst=10.0.0.2 action=deny", "unknown", 9), ("no source", None, 10)]
    lines = spark.createDataFrame(given, "line string, origin string, line_no long")
    got = {r.line_no: r for r in onboard_sources(lines, config, "origin", "2026-06-01 00:00:00").collect()}
    assert len(got) == 6 and got[10].outcome == "failed"
    assert (got[0].source.vendor, got[0].source.device_type, got[0].network.source_ip) == ("V0", "proxy", None)
    assert [(got[i].source.vendor, got[i].network.source_ip, got[i].network.destination_ip) for i in (1, 4999)] == [
        ("V1", "10.0.0.1", "10.0.0.1"), ("V4999", "10.0.19.249", "10.0.19.249")]
    assert (got[9].source.vendor, got[9].network.source_ip, got[9].event.action) == ("Generic", "10.0.0.1", "deny")
    one = onboard_source(lines.filter("line_no = 4999"), config, "2026-06-01 00:00:00", source="s4999").first()
    assert (one.source.vendor, one.network.source_ip) == ("V4999", "10.0.19.249")
    with pytest.raises(ValueError):
        onboard_source(lines, config)
