"""Result schemas of the feature tables."""

PORT_SCAN = (
    "src_ip string, distinct_ports bigint, distinct_hosts bigint, total_conns bigint"
)
BRUTE_FORCE = "src_ip string, failed_attempts bigint, dst_ip string"
BEACON_INTERVALS = "src_ip string, dst_ip string, ts double, interval double"
BEACONING = (
    "src_ip string, dst_ip string, n_conns bigint, mean_interval double, jitter double"
)
DNS = "src_ip string, query string, qlen int, entropy double"
PARENTS = "domain string, level int, queries bigint, names bigint, entropy double"
EXFILTRATION = "src_ip string, dst_ip string, total_orig_bytes decimal(38,0), n_conns bigint"
