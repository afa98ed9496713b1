"""Raw log lines rendered from the ``events`` table, one template per format and branch.

The registered queries parse these lines; their reference SQL derives the same answers from the
table's columns without parsing anything.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmeld.session import spread

INGEST_TS = "2024-03-01 00:00:00"
REF_YEAR = 2024

# Columns both sides start from; also valid in the reference SQL's dialect.
STEP1 = """
select event_id, user_id, event_type, ts,
 event_id % 12 as tpl,
 case when event_id % 97 = 0 then 1 else 0 end as is_bad,
 case when event_id % 5 = 0 then '203.0.113.' || cast(user_id % 254 + 1 as string)
      else '10.' || cast(user_id % 256 as string) || '.' || cast(event_id % 256 as string) || '.' || cast(event_id % 254 + 1 as string) end as src_ip,
 case when event_id % 13 = 0 then '198.51.100.' || cast(event_id % 254 + 1 as string)
      else '192.168.' || cast(user_id % 256 as string) || '.' || cast(event_id % 254 + 1 as string) end as dst_ip,
 1024 + event_id % 60000 as src_port,
 case event_id % 11 when 0 then 443 when 1 then 22 when 2 then 4444 when 3 then 3389 when 4 then 53 when 5 then 8080
      when 6 then 0 when 7 then 445 when 8 then 80 when 9 then 31337 else 123 end as dst_port,
 case user_id % 3 when 0 then '6' when 1 then 'udp' else 'TCP' end as proto_raw,
 case event_type when 'click' then 'Permit' when 'view' then 'built' when 'purchase' then 'blocked'
      when 'signup' then 'Deny' else 'detected' end as action_raw,
 (event_id % 17) % 8 as sev_code,
 cast(round(value * 100) as bigint) * 1000 as bytes_sent,
 case event_id % 7 when 0 then 'port scan seen' when 1 then 'failed password for root' when 2 then 'smb share opened'
      when 3 then 'admin console' when 4 then 'psexec run' else 'plain traffic' end as msg
from events
"""

CSV_HEADER = (
    "timestamp,vendor,device_type,src_ip,dst_ip,src_port,dst_port,proto,action,user,status"
)

_LINE = """
case
 when is_bad = 1 and tpl % 2 = 0 then 'CEF:bad|only|two'
 when is_bad = 1 then format_string('console note without structure %s', event_id)
 when tpl = 0 then format_string('<%s>1 %s edge%s TRAFFIC - - - src=%s dst=%s sport=%s dport=%s proto=%s action=%s bytes_sent=%s note %s',
   160 + sev_code, iso, user_id, src_ip, dst_ip, src_port, dst_port, proto_raw, action_raw, bytes_sent, msg)
 when tpl = 1 then format_string('<%s>%s edge%s sshd[%s]: %s', 160 + sev_code, bsd, user_id, user_id, msg)
 when tpl = 2 then format_string('<164>%s edge : %%ASA-%s-106023: Deny tcp src outside:%s/%s dst inside:%s/%s by access-group "x"',
   bsd, sev_code, src_ip, src_port, dst_ip, dst_port)
 when tpl = 3 then format_string('<166>%s edge : %%ASA-6-302013: Built outbound TCP connection %s for outside:%s/%s',
   bsd, event_id, dst_ip, dst_port)
 when tpl = 4 then format_string('CEF:0|Acme|Gate Firewall|1.0|%s|Flow|%s|src=%s dst=%s spt=%s dpt=%s proto=%s act=%s out=%s msg=%s',
   event_id, sev_code, src_ip, dst_ip, src_port, dst_port, proto_raw, action_raw, bytes_sent, msg)
 when tpl = 5 then format_string('<134>%s relay CEF:0|Acme|Gate VPN|1.0|%s|Flow|%s|src=%s dst=%s dpt=%s act=none act=%s cs1=a\\\\=b msg=%s',
   bsd, event_id, sev_code, src_ip, dst_ip, dst_port, action_raw, msg)
 when tpl = 6 then concat('LEEF:1.0|Acme|Gate|7|', event_id, '|', concat_ws('\\t', concat('src=', src_ip), concat('dst=', dst_ip),
   concat('spt=', src_port), concat('dpt=', dst_port), concat('proto=', proto_raw), concat('act=', action_raw), concat('devname=gw', user_id)))
 when tpl = 7 then format_string('LEEF:2.0|Acme|IDS box|7|%s|^|src=%s^dst=%s^dpt=%s^act=%s^msg=%s', event_id, src_ip, dst_ip, dst_port, action_raw, msg)
 when tpl = 8 then format_string('{"timestamp":"%s","event_type":"alert","src_ip":"%s","dest_ip":"%s","src_port":%s,"dest_port":%s,"proto":"%s","action":"%s","alert":{"signature":"%s","severity":%s}}',
   iso, src_ip, dst_ip, src_port, dst_port, proto_raw, action_raw, msg, sev_code)
 when tpl = 9 then format_string('{"u":"x","flow":{"a":1,"b":[1,{"c":2}]},"src":"%s","dst":"%s","dport":"%s","act":"%s"}', src_ip, dst_ip, dst_port, action_raw)
 when tpl = 10 then format_string('devname=FG100 srcip=%s dstip=%s srcport=%s dstport=%s proto=%s action=%s sentbyte=%s level=warning msg="%s"',
   src_ip, dst_ip, src_port, dst_port, proto_raw, action_raw, bytes_sent, msg)
 else format_string('%s,PulseSecure,vpn,%s,%s,%s,%s,%s,%s,user%s,tunnel_active', iso, src_ip, dst_ip, src_port, dst_port, proto_raw, action_raw, user_id)
end
"""


def step1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground-truth columns of every event, dealt evenly: the work on the lines is the larger part."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return step1_of(spread(events))


def step1_of(events: DataFrame) -> DataFrame:
    select = STEP1.strip().removeprefix("select").rsplit("from events", 1)[0]
    return events.selectExpr(*_split_top_level(select))


def _split_top_level(select: str) -> list[str]:
    items, depth, current = [], 0, ""
    for ch in select:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            items.append(current.strip())
            current = ""
        else:
            current += ch
    return [*items, current.strip()]


def render(truth: DataFrame) -> DataFrame:
    """Ground truth -> the same rows with ``line``, ``file_path`` and ``line_no``."""
    return truth.withColumns({
        "iso": F.expr("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"),
        "bsd": F.expr("date_format(ts, 'MMM dd HH:mm:ss')"),
        "file_path": F.expr("concat('f', user_id % 4)"),
        "line_no": F.col("event_id"),
    }).withColumn("line", F.expr(_LINE)).drop("iso", "bsd")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: every event as a line, and the header row of each delimited file before its lines."""
    lines = render(step1(spark, sf_dir)).select("line", "file_path", "line_no")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    headers = (
        events.select(F.expr("concat('f', user_id % 4)").alias("file_path")).distinct()
        .select(F.lit(CSV_HEADER).alias("line"), "file_path", F.lit(-1).cast("bigint").alias("line_no"))
    )
    return lines.unionByName(headers)
