"""Fixed values. These must stay exactly as they are for results to agree.

Word lists, field names, lookup tables, constants and patterns only; no logic lives here.
"""

# --- fixed values: parser registry, in order of preference -------------------------------
# (parser, format, vendor, device_type)
PARSERS = [
    ("cef-arcsight-v1", "CEF", "ArcSight-CEF", "network_security"),
    ("leef-qradar-v1", "LEEF", "LEEF-QRadar", "network_security"),
    ("json-universal-v1", "JSON", "JSON-Source", "network_device"),
    ("keyvalue-network-v1", "KEY_VALUE", "Network-Firewall", "firewall"),
    ("syslog-rfc3164-5424", "SYSLOG", "Generic-Syslog", "network_device"),
    ("csv-delimited-v1", "CSV", "CSV-Source", "network_device"),
]
FORMATS = [fmt for _, fmt, _, _ in PARSERS]
PARSER_OF = {fmt: parser for parser, fmt, _, _ in PARSERS}

# --- fixed values: detection -------------------------------------------------------------
JSON_KNOWN_KEYS = [
    "timestamp", "time", "datetime", "event_type", "src_ip", "dst_ip", "action", "severity",
    "message", "msg", "source", "destination", "alert", "host", "hostname",
]
FIREWALL_KEYS = [
    "src", "srcip", "dst", "dstip", "proto", "action", "status", "sport", "dport", "spt", "dpt",
]
MIN_CONFIDENCE = 0.2
DELIMITERS = [",", ";", "\t", "|"]
HEADER_WORDS = [
    "timestamp", "time", "date", "datetime", "src_ip", "dst_ip", "source", "destination",
    "action", "protocol", "port", "severity", "hostname", "user", "message", "type", "status",
    "bytes", "packets", "duration", "srcip", "dstip", "sport", "dport",
]

# --- fixed values: JSON vendor signatures (keywords, vendor, device_type), first hit wins -
JSON_VENDOR_SIGNATURES = [
    (["event_type", "alert", "signature_id"], "Suricata", "ids"),
    (["alert", "category", "signature"], "Suricata", "ids"),
    (["snort"], "Snort", "ids"),
    (["zeek", "uid", "conn"], "Zeek", "ids"),
    (["fortigate", "devname"], "Fortinet", "firewall"),
    (["paloalto", "pan-os"], "PaloAlto", "firewall"),
    (["checkpoint"], "CheckPoint", "firewall"),
    (["cisco", "asa"], "Cisco", "firewall"),
    (["f5", "bigip", "big-ip"], "F5", "load_balancer"),
    (["waf", "web application firewall"], "WAF", "waf"),
    (["cloudflare"], "Cloudflare", "cdn"),
    (["aws", "cloudtrail"], "AWS", "cloud"),
    (["azure", "entra"], "Microsoft", "cloud"),
    (["gcp", "google_cloud"], "Google", "cloud"),
]

# --- fixed values: field aliases, first usable one wins ----------------------------------
ALIASES = {
    "source_ip": [
        "src", "src_ip", "srcip", "sourceaddress", "sourceip", "src_addr", "source", "c-ip",
        "source_address", "s_ip", "src_host", "client_ip", "clientip", "originator_ip",
    ],
    "destination_ip": [
        "dst", "dst_ip", "dstip", "destinationaddress", "destinationip", "dst_addr",
        "destination", "cs-ip", "dest_address", "d_ip", "dest_ip", "target_ip", "server_ip",
        "responder_ip",
    ],
    "source_port": [
        "sport", "spt", "src_port", "sourceport", "srcport", "s_port", "client_port",
    ],
    "destination_port": [
        "dport", "dpt", "dst_port", "destinationport", "dstport", "d_port", "target_port",
        "server_port",
    ],
    "protocol": ["proto", "protocol", "app_proto", "transport", "trans_protocol", "service"],
    "action": ["action", "act", "status", "decision", "event_action", "result", "disposition"],
    "severity": [
        "severity", "severity_code", "pri", "level", "cef_severity", "priority", "threat_level",
        "risk",
    ],
    "timestamp": [
        "timestamp", "rt", "time", "date", "datetime", "event_time", "start", "end", "logged",
        "received_at", "generated_time",
    ],
    "user": [
        "user", "username", "usr", "srcuser", "dstuser", "login", "account", "user_name", "uid",
        "user_id",
    ],
    "hostname": [
        "hostname", "host", "devname", "device_name", "syslog_host", "node", "computer_name",
        "machine",
    ],
    "source_user": ["srcuser", "src_user"],
    "destination_user": ["dstuser", "dst_user"],
    "process": ["app_name", "app", "application"],
    "pid": ["pid", "proc_id", "process_id"],
    "device_ip": ["ip", "device_ip"],
    "bytes_sent": ["bytes_sent", "out", "sentbyte"],
    "bytes_received": ["bytes_received", "in", "rcvdbyte"],
    "packets": ["packets"],
    "event_type": ["event_name", "event_type"],
    "category": ["category", "event_type"],
    "message": ["message", "msg"],
    "threat_text": ["message", "msg", "event_name"],
}

# --- fixed values: label maps ------------------------------------------------------------
ACTION_WORDS = {
    "allow": [
        "allow", "permit", "pass", "accept", "built", "allowed", "success", "connected",
        "granted", "established", "open", "login",
    ],
    "deny": [
        "deny", "drop", "block", "blocked", "reject", "teardown", "reset", "failed", "refused",
        "discard", "close", "timeout", "terminated", "aborted",
    ],
    "alert": ["alert", "warn", "warning", "flagged", "detected", "quarantine", "suspicious"],
}
SEVERITY_WORDS = {
    "critical": ["emergency", "emerg", "alert", "critical", "crit"],
    "high": ["error", "err", "high", "major"],
    "medium": ["warning", "warn", "medium", "med"],
    "low": ["notice", "low", "minor"],
    "informational": ["info", "informational", "debug", "trace"],
}
SEVERITIES = ["critical", "high", "medium", "low", "informational"]
PROTOCOL_NUMBERS = {
    "1": "ICMP", "2": "IGMP", "6": "TCP", "17": "UDP", "47": "GRE", "50": "ESP", "51": "AH",
    "58": "IPv6-ICMP", "89": "OSPF", "132": "SCTP",
}
CATEGORY_WORDS = {
    "authentication": ["auth", "login", "logon", "logout", "logoff", "credential"],
    "security": ["threat", "alert", "intrusion", "malware", "attack", "anomaly"],
    "system": ["system", "audit", "config", "startup", "shutdown"],
}
CATEGORY_ACTIONS = {
    "authentication": ["login", "logon", "logout", "logoff"],
    "security": ["alert", "quarantine", "detected"],
}
CATEGORY_MESSAGE_WORDS = ["login", "authentication", "password", "credential", "session"]

# --- fixed values: threat rules ----------------------------------------------------------
ACTION_SCORES = {"deny": 15, "alert": 30}
SEVERITY_SCORES = {"critical": 40, "high": 25, "medium": 10, "low": 5}
C2_PORTS = [4444, 5555, 8888, 1234, 31337, 6667, 6668, 6669]
RECON_PORTS = [0]
HIGH_RISK_PORTS = [445, 3389, 22, 23, 1433, 3306, 5432, 5900, 27017]
PORT_SCORES = {"C2Beaconing": 35, "Reconnaissance": 20, "BruteForce": 15}
LARGE_EGRESS_BYTES = 10_000_000
LARGE_EGRESS_SCORE = 25
THREAT_WORDS = {
    "PortScan": (["scan", "probe", "sweep", "fingerprint"], 20),
    "BruteForce": (["brute", "failed password", "invalid user", "authentication fail"], 25),
    "LateralMovement": (["lateral", "psexec", "wmi ", "smb "], 20),
    "PrivilegeEsc": (["privilege", "escalat", "root", "admin"], 15),
}
INBOUND_DENIED_SCORE = 10
DETECTION_SCORE = 30
TECHNIQUES = {
    "BruteForce": "T1110",
    "PortScan": "T1046",
    "C2Beaconing": "T1071",
    "DataExfiltration": "T1041",
    "Reconnaissance": "T1595",
    "LateralMovement": "T1021",
    "PrivilegeEsc": "T1068",
}

# --- fixed values: output columns --------------------------------------------------------
EVENT_TABLE_COLUMNS = [
    "event_id", "timestamp", "source_vendor", "source_device_type", "hostname", "source_ip",
    "destination_ip", "source_port", "destination_port", "protocol", "action", "severity",
    "category", "threat_detected", "threat_type", "risk_score", "normalized_json", "raw_event",
    "created_at",
]
CSV_EXPORT_COLUMNS = [
    "event_id", "timestamp", "vendor", "device_type", "hostname", "category", "event_type",
    "action", "severity", "source_ip", "destination_ip", "source_port", "destination_port",
    "protocol", "bytes_sent", "bytes_received", "threat_detected", "threat_type",
    "mitre_technique_id", "risk_score", "geo_source", "geo_destination", "user", "process",
    "parser", "source_format", "confidence", "raw_event",
]
FAILED_CSV_COLUMNS = [
    "event_id", "timestamp", "reason", "detected_format", "parser_attempted", "raw_event",
]
SCHEMA_VERSION = "1.0"
