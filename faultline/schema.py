"""Canonical table layouts, accepted column names and default settings."""

from __future__ import annotations

from pyspark.sql import types as T

AVIATION = "Aviation"
POWER = "Power Grid"
OTHER = "Other"

# Accepted source column names and the canonical column each one feeds.
COLUMN_ALIASES = {
    "Report 1_Narrative": "narrative",
    "Events_Anomaly": "label",
    "Narrative": "narrative",
    "human_factors_groundtruth": "label",
    "Domain": "domain",
    "narrative": "narrative",
    "label": "label",
    "domain": "domain",
}
CANONICAL = ("narrative", "label", "domain")

# Default settings of the batch job and the monitor.
TOP_LABELS = 15
MIN_NARRATIVE_CHARS = 20
MAX_FEATURES = 5000
LEGACY_MAX_FEATURES = 3000
TEST_SHARE = 0.2
SEED = 42
CV_FOLDS = 3
MAX_ITER = 1000
TOLERANCE = 1e-3
GRID_ALPHAS = (1e-5, 1e-4, 1e-3)
GRID_CLASS_WEIGHTS = (None, "balanced")
EVIDENCE_TOP_K = 3
EXPLAIN_SAMPLES = 100
EVIDENCE_CHARS = 170
ALERT_CHARS = 200
INPUT_CHARS = 120
PREVIEW_CHARS = 100
PREVIEW_ROWS = 30
HIGH_RISK_CUSTOMERS = 100
LOOP_SECONDS = 60
ACCIDENT_FEED_SECONDS = 3600
FAULT_FEED_SECONDS = 60

EVIDENCE_ITEM = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("snippet", T.StringType()),
    ]
)
EVIDENCE = T.ArrayType(EVIDENCE_ITEM)

ALERT_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("incident_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("predicted_label", T.StringType()),
        T.StructField("narrative", T.StringType()),
        T.StructField("evidence_json", T.StringType()),
    ]
)

ACCIDENT_RECORD = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "ev_id",
            "ev_date",
            "acft_make",
            "acft_model",
            "ev_city",
            "ev_state",
            "ev_country",
            "ev_highest_injury",
            "probable_cause",
        )
    ]
)

FAULT_FIELDS = T.StructType(
    [
        T.StructField("incidentreference", T.StringType()),
        T.StructField("powercuttype", T.StringType()),
        T.StructField("mainmessage", T.StringType()),
        T.StructField("incidentcategorycustomerfriendlydescription", T.StringType()),
        T.StructField("operatingzone", T.StringType()),
        T.StructField("postcodesaffected", T.StringType()),
        T.StructField("nocustomeraffected", T.StringType()),
    ]
)
# A record arrives flat, under `fields`, or under `record.fields`.
FAULT_RECORD = T.StructType(
    FAULT_FIELDS.fields
    + [
        T.StructField("fields", FAULT_FIELDS),
        T.StructField("record", T.StructType(FAULT_FIELDS.fields + [T.StructField("fields", FAULT_FIELDS)])),
    ]
)
