"""Column layout of the tables the operators exchange."""

from pyspark.sql import types as T

INTERNAL_IP = "Internal"
UNKNOWN_USER = "unknown"

FAILED = "FAILED_LOGIN"
SUCCESS = "SUCCESSFUL_LOGIN"
ROOT = "ROOT_ACCESS"
SUDO = "SUDO_ATTEMPT"
INVALID = "INVALID_USER"
DISCONNECT = "DISCONNECT"
OTHER = "OTHER"

AUTH_EVENTS = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("timestamp_str", T.StringType()),
        T.StructField("parsed_time", T.TimestampNTZType()),
        T.StructField("event", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("process", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw_line", T.StringType()),
    ]
)

# Total order of events: wall-clock first, position in the log as tie-break.
EVENT_ORDER = ["parsed_time", "source_file", "line_number"]

# Columns added by later stages and the value an event has before that stage ran.
OVERLAY_DEFAULTS = {
    "geo_country": ("string", ""),
    "geo_city": ("string", ""),
    "geo_lat": ("double", 0.0),
    "geo_lon": ("double", 0.0),
    "ip_reputation": ("double", 0.5),
    "asn": ("string", ""),
    "mitre_technique": ("string", ""),
    "mitre_tactic": ("string", ""),
    "anomaly_score": ("double", 0.0),
    "cluster_id": ("int", -1),
    "hmm_state": ("string", ""),
    "risk_score": ("double", 0.0),
    "severity_level": ("string", "LOW"),
    "session_id": ("string", ""),
    "attack_chain_id": ("string", ""),
    "tamper_flag": ("int", 0),
}

IP_FEATURE_COLUMNS = [
    "failed_count",
    "success_count",
    "total_events",
    "hour_mean",
    "hour_std",
    "unique_users",
    "iet_mean",
    "iet_std",
    "iet_min",
    "night_logins",
    "ip_reputation",
    "geo_risk",
    "fail_ratio",
]
