"""Fixed values. They decide results, so they are stated here as plain text."""

# Zeek log conventions.
UNSET_FIELD = "-"
EMPTY_FIELD = "(empty)"
SET_SEPARATOR = ","
FIELDS_TAG = "#fields"

# Logs the bundle loads; "files" can be read on its own.
BUNDLE = ("conn", "dns", "http", "ssl")

# Columns that are always numbers, whatever the log.
NUMERIC_FIELDS = (
    "id.orig_p",
    "id.resp_p",
    "duration",
    "orig_bytes",
    "resp_bytes",
    "orig_pkts",
    "resp_pkts",
    "orig_ip_bytes",
    "resp_ip_bytes",
    "missed_bytes",
    "ts",
)

# Names a logical column may have, in order of preference.
# "id.orig_h" is called "id_orig_h" once a log is loaded.
ALIASES = {
    "src": ("id_orig_h", "id.orig_h", "orig_h", "src_ip"),
    "dst": ("id_resp_h", "id.resp_h", "resp_h", "dst_ip"),
    "port": ("id_resp_p", "id.resp_p", "resp_p", "dst_port"),
    "state": ("conn_state", "state"),
    "time": ("ts", "timestamp"),
    "query": ("query", "qname"),
    "bytes": ("orig_bytes", "orig_ip_bytes"),
}

# Connection states that count as a failed attempt.
FAILED_STATES = ("REJ", "S0", "RSTO", "RSTR", "RSTOS0", "SH")

# Fewest connections of a pair that make its intervals meaningful.
MIN_BEACON_CONNECTIONS = 3

# Source written for a DNS log that has no source column.
NO_SOURCE = "N/A"

# Default thresholds.
THRESHOLDS = {
    "port_scan": {"min_ports": 50, "window_sec": 60},
    "brute_force": {"min_attempts": 10, "window_sec": 60, "port": 22},
    "beaconing": {"max_jitter": 0.10, "min_connections": 10},
    "dns_tunnel": {"min_entropy": 3.5},
    "exfiltration": {"max_bytes": 1_000_000},
}

# Severities, least first.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# Alert texts (printf formats).
PORT_SCAN_TEXT = (
    "Port scan detecte : %d ports distincts contactes sur %d hote(s) (seuil : %s)"
)
BRUTE_FORCE_TEXT = (
    "Brute force SSH detecte : %d tentatives echouees sur le port %s (seuil : %s)"
)
BEACONING_TEXT = (
    "Beaconing C2 detecte : %d connexions tres regulieres "
    "(jitter %.1f%%, intervalle moyen %.0fs, seuil jitter %s)"
)
ALERT_LINE = "[%s] %s — %s → %s : %s%s"
CTI_MARK = " [CTI ✓]"
NO_TARGET = "N/A"

# Texts of the two detectors that have thresholds but no reference wording.
DNS_TUNNEL_TEXT = "Tunnel DNS suspect : %s (entropie %.3f, longueur %d, seuil : %s)"
EXFILTRATION_TEXT = (
    "Exfiltration suspecte : %s octets sortants sur %d connexions (seuil : %s)"
)

# Summary breakdown.
BREAKDOWN_ITEM = "%s: %d"
BREAKDOWN_SEPARATOR = " · "
