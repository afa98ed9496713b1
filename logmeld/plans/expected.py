"""Reference SQL: the answers derived from the ``events`` table's columns, without any parsing."""

from logmeld.plans.fixture_lines import INGEST_TS, STEP1

# One row per event with everything the rendered line should turn into.
EXPECTED = f"""
with base as ({STEP1}),
x as (
 select *, 'f' || cast(user_id % 4 as string) as file_path,
  case when is_bad = 0 then 'event' else 'failed' end as outcome,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(ts, '%b %d %H:%M:%S') as bsd,
  date_trunc('second', ts) as ts_sec,
  case when event_type in ('click', 'view') then 'allow' when event_type in ('purchase', 'signup') then 'deny' else 'alert' end as act,
  case when user_id % 3 = 1 then 'UDP' else 'TCP' end as proto,
  case when sev_code < 2 then 'critical' when sev_code < 4 then 'high' when sev_code = 4 then 'medium'
       when sev_code = 5 then 'low' else 'informational' end as sev
 from base),
ev as (
 select event_id as line_no, file_path, tpl, is_bad, outcome, user_id, event_type as kind, ts, ts_sec, iso, bsd, msg, act, sev_code,
  proto_raw, action_raw, src_ip, dst_ip, src_port, dst_port, bytes_sent as raw_bytes,
  case when tpl in (0, 1) then 'SYSLOG' when tpl in (2, 3, 10) then 'KEY_VALUE' when tpl in (4, 5) then 'CEF'
       when tpl in (6, 7) then 'LEEF' when tpl in (8, 9) then 'JSON' else 'CSV' end as format,
  cast(case when tpl in (0, 2, 3) then 0.98 when tpl in (1, 10) then 0.95 when tpl in (4, 5, 6, 7, 8) then 0.99
       when tpl = 9 then 0.92 else 0.85 end as double) as confidence,
  case when tpl in (0, 1, 3, 9) then 'Generic' when tpl = 2 then 'Cisco' when tpl in (4, 5, 6, 7) then 'Acme'
       when tpl = 8 then 'Suricata' when tpl = 10 then 'Fortinet' else 'PulseSecure' end as vendor,
  case when tpl in (0, 1, 3, 6, 9) then 'network_device' when tpl in (2, 4, 10) then 'firewall' when tpl in (5, 11) then 'vpn' else 'ids' end as device_type,
  case when tpl in (0, 1) then 'edge' || cast(user_id as string) when tpl = 6 then 'gw' || cast(user_id as string) when tpl = 10 then 'FG100' end as hostname,
  case when tpl not in (1, 3) then src_ip end as source_ip,
  case when tpl not in (1, 3) then dst_ip end as destination_ip,
  cast(case when tpl not in (1, 3, 5, 7, 9) then src_port end as integer) as source_port,
  cast(case when tpl not in (1, 3, 8) then dst_port end as integer) as destination_port,
  case when tpl = 2 then 'TCP' when tpl in (0, 4, 6, 8, 10, 11) then proto end as protocol,
  case when tpl in (1, 3) then 'unknown' when tpl = 2 then 'deny' else act end as action,
  case when tpl in (0, 1, 2, 4, 5, 8) then sev when tpl = 10 then 'medium' else 'informational' end as severity,
  case when tpl in (0, 1, 4, 5, 7, 8, 10) then msg else '' end as threat_text,
  case when tpl = 8 or (tpl not in (1, 2, 3) and act = 'alert') then 'security'
       when tpl in (0, 1, 4, 5, 7, 10) and msg like '%password%' then 'authentication' else 'network' end as category,
  case when tpl in (0, 4, 10) then bytes_sent end as bytes_sent,
  case when tpl = 11 then 'user' || cast(user_id as string) end as user_name,
  case when tpl = 0 then 'TRAFFIC' when tpl = 1 then 'sshd' end as process_name,
  case when tpl = 1 then cast(user_id as string) end as pid,
  case when tpl in (4, 5) then 'Flow' when tpl in (6, 7) then cast(event_id as string) when tpl = 8 then msg else 'connection' end as type,
  case when tpl in (0, 1, 8, 11) then ts_sec else timestamp '{INGEST_TS}' end as timestamp,
  case when tpl in (0, 1, 8, 11) then 'event' else 'ingest' end as timestamp_source
 from x),
ev2 as (
 select *,
  case format when 'CEF' then 'cef-arcsight-v1' when 'LEEF' then 'leef-qradar-v1' when 'JSON' then 'json-universal-v1'
   when 'KEY_VALUE' then 'keyvalue-network-v1' when 'SYSLOG' then 'syslog-rfc3164-5424' else 'csv-delimited-v1' end as parser,
  case action when 'deny' then 15 when 'alert' then 30 else 0 end as action_points,
  case severity when 'critical' then 40 when 'high' then 25 when 'medium' then 10 when 'low' then 5 else 0 end as severity_points,
  case when destination_port in (4444, 31337) then 'C2Beaconing' when destination_port = 0 then 'Reconnaissance'
       when destination_port in (22, 3389, 445) and action = 'deny' then 'BruteForce' end as port_kind,
  coalesce(bytes_sent > 10000000, false) as egress,
  threat_text like '%scan%' as w_scan, threat_text like '%failed password%' as w_brute,
  (threat_text like '%psexec%' or threat_text like '%smb %') as w_lateral,
  (threat_text like '%root%' or threat_text like '%admin%') as w_priv,
  (source_ip is null or source_ip not like '203.%') as src_private,
  (destination_ip is null or destination_ip not like '198.%') as dst_private
 from ev),
ev3 as (
 select *,
  case when w_brute then 'BruteForce' else coalesce(port_kind, case when egress then 'DataExfiltration' when w_scan then 'PortScan'
    when w_lateral then 'LateralMovement' when w_priv then 'PrivilegeEsc' end) end as threat_type,
  case port_kind when 'C2Beaconing' then 35 when 'Reconnaissance' then 20 when 'BruteForce' then 15 else 0 end as port_points,
  case when egress then 25 else 0 end as egress_points,
  (case when w_scan then 20 else 0 end + case when w_brute then 25 else 0 end + case when w_lateral then 20 else 0 end + case when w_priv then 15 else 0 end) as word_points,
  case when not src_private and dst_private and action = 'deny' then 10 else 0 end as inbound_points
 from ev2),
exp as (
 select *,
  least(100, action_points + severity_points + port_points + egress_points + word_points + inbound_points) as risk_score,
  (action_points + severity_points + port_points + egress_points + word_points + inbound_points >= 30 or threat_type is not null) as threat_detected,
  case threat_type when 'BruteForce' then 'T1110' when 'PortScan' then 'T1046' when 'C2Beaconing' then 'T1071' when 'DataExfiltration' then 'T1041'
    when 'Reconnaissance' then 'T1595' when 'LateralMovement' then 'T1021' when 'PrivilegeEsc' then 'T1068' end as mitre_technique_id,
  case when src_private then 'Internal LAN' else 'External' end as geo_source,
  case when dst_private then 'Internal LAN' else 'External' end as geo_destination
 from ev3),
ok as (select * from exp where is_bad = 0),
bad as (
 select line_no, file_path,
  case when tpl % 2 = 0 then 'CEF' else 'unknown' end as detected_format,
  case when tpl % 2 = 0 then 'cef-arcsight-v1' end as parser_attempted,
  case when tpl % 2 = 0 then 'CEF:bad|only|two' else 'console note without structure ' || cast(line_no as string) end as raw_event,
  case when tpl % 2 = 0 then 'Parser ''cef-arcsight-v1'' extraction error: ValueError: Line does not conform to CEF format: CEF:bad|only|two'
   else 'No suitable parser detected (confidence=0.00; line_prefix=''console note without structure ' || cast(line_no as string) || ''')' end as reason
 from exp where is_bad = 1)
"""


def over(select: str) -> str:
    """The reference SQL for a select over ``ok`` (events), ``bad`` (quarantine) or ``exp`` (both)."""
    return f"{EXPECTED}\n{select}"


def over_truth(select: str) -> str:
    """The reference SQL for a select over ``base``, the ground-truth columns alone."""
    return f"with base as ({STEP1})\n{select}"
