"""Log field types and the alert table."""

from __future__ import annotations

from pyspark.sql import types as T

from netbehave.constants import NUMERIC_FIELDS

# The fields of the logs and their Zeek types, in file order.
CONN_FIELDS = {
    "ts": "time",
    "uid": "string",
    "id.orig_h": "addr",
    "id.orig_p": "port",
    "id.resp_h": "addr",
    "id.resp_p": "port",
    "proto": "enum",
    "service": "string",
    "duration": "interval",
    "orig_bytes": "count",
    "resp_bytes": "count",
    "conn_state": "string",
    "local_orig": "bool",
    "local_resp": "bool",
    "missed_bytes": "count",
    "history": "string",
    "orig_pkts": "count",
    "orig_ip_bytes": "count",
    "resp_pkts": "count",
    "resp_ip_bytes": "count",
    "tunnel_parents": "set[string]",
    "ip_proto": "count",
}
DNS_FIELDS = {
    "ts": "time",
    "uid": "string",
    "id.orig_h": "addr",
    "id.orig_p": "port",
    "id.resp_h": "addr",
    "id.resp_p": "port",
    "proto": "enum",
    "trans_id": "count",
    "rtt": "interval",
    "query": "string",
    "qclass": "count",
    "qclass_name": "string",
    "qtype": "count",
    "qtype_name": "string",
    "rcode": "count",
    "rcode_name": "string",
    "AA": "bool",
    "TC": "bool",
    "RD": "bool",
    "RA": "bool",
    "Z": "count",
    "answers": "vector[string]",
    "TTLs": "vector[interval]",
    "rejected": "bool",
}
PACKET_FILTER_FIELDS = {
    "ts": "time",
    "node": "string",
    "filter": "string",
    "init": "bool",
    "success": "bool",
    "failure_reason": "string",
}
LOG_FIELDS = {
    "conn": CONN_FIELDS,
    "dns": DNS_FIELDS,
    "packet_filter": PACKET_FILTER_FIELDS,
}

# Logs without a listed layout take it from their header; these fields start any of them.
COMMON_FIELDS = {"ts": "time", "uid": "string"}

SPARK_TYPES = {
    "time": "double",
    "interval": "double",
    "count": "bigint",
    "port": "int",
    "bool": "boolean",
    "set[string]": "array<string>",
    "vector[string]": "array<string>",
    "vector[interval]": "array<double>",
}

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("detector", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("src_ip", T.StringType(), False),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("description", T.StringType(), False),
        T.StructField("mitre", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("cti_context", T.StringType()),
    ]
)
ALERT_COLUMNS = ALERT_SCHEMA.fieldNames()


def fields_of(log_name: str) -> tuple[str, ...]:
    """Usual layout of a log."""
    return tuple(LOG_FIELDS.get(log_name, COMMON_FIELDS))


def zeek_type(log_name: str, field: str) -> str:
    """Type of a field; a field of no listed layout is a string unless always a number."""
    known = LOG_FIELDS.get(log_name, {})
    if field in known:
        return known[field]
    for fields in (CONN_FIELDS, COMMON_FIELDS):
        if field in fields and (field in NUMERIC_FIELDS or fields is COMMON_FIELDS):
            return fields[field]
    return "string"


def column_name(field: str) -> str:
    """Field name without dots, so that it needs no quoting in SQL."""
    return field.replace(".", "_")
