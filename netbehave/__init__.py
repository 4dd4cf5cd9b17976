"""Network-behaviour analytics on Spark: logs to features to alerts."""

from netbehave.operators.beaconing import beacon_intervals, beaconing_features
from netbehave.operators.connections import (
    brute_force_features,
    exfil_features,
    port_scan_features,
)
from netbehave.operators.dns import dns_features, text_entropy
from netbehave.operators.domains import parent_domain_features
from netbehave.operators.enrich import enrich
from netbehave.operators.pair_state import beaconing_stateful
from netbehave.operators.port_bitmaps import merged_ports, port_bitmap_windowed, port_words
from netbehave.operators.prefixes import enrich_prefixes
from netbehave.operators.sessions import exfil_sessions
from netbehave.operators.windowed import (
    beaconing_windowed,
    brute_force_windowed,
    port_scan_windowed,
)
from netbehave.plans.detectors import (
    BeaconingDetector,
    BruteForceDetector,
    Detector,
    DnsTunnelDetector,
    ExfiltrationDetector,
    PortScanDetector,
    default_detectors,
    to_alerts,
)
from netbehave.plans.pipeline import Run, detect, run, stage_logs
from netbehave.plans.report import alert_json, ranked, render, severity_histogram, summary
from netbehave.sources.alert_store import AlertStore, new_alert
from netbehave.sources.logs import load_logs, read_log
from netbehave.sources.sketch_store import SketchStore

__all__ = [
    "AlertStore",
    "BeaconingDetector",
    "BruteForceDetector",
    "Detector",
    "DnsTunnelDetector",
    "ExfiltrationDetector",
    "PortScanDetector",
    "Run",
    "SketchStore",
    "alert_json",
    "beacon_intervals",
    "beaconing_features",
    "beaconing_stateful",
    "beaconing_windowed",
    "brute_force_features",
    "brute_force_windowed",
    "default_detectors",
    "detect",
    "dns_features",
    "enrich",
    "enrich_prefixes",
    "exfil_features",
    "exfil_sessions",
    "load_logs",
    "merged_ports",
    "new_alert",
    "parent_domain_features",
    "port_bitmap_windowed",
    "port_scan_features",
    "port_scan_windowed",
    "port_words",
    "ranked",
    "read_log",
    "render",
    "run",
    "severity_histogram",
    "stage_logs",
    "summary",
    "text_entropy",
    "to_alerts",
]
