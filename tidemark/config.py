"""Fixed values the results depend on."""

from __future__ import annotations

# Point-in-time windows (seconds).
VELOCITY_WINDOWS = {"1h": 3600, "24h": 86400, "7d": 604800}
STATS_WINDOWS = {"30d": 2592000}
VELOCITY_ENTITIES = ["card1", "addr1", "DeviceInfo", "P_emaildomain"]
STATS_BY_ENTITY = {"card1": ["mean", "std", "max"], "addr1": ["mean", "std"]}
SUPPORTED_STATS = ("mean", "std", "max")

# Decay rates per hour.
EWM_LAMBDAS = [0.05, 0.1, 0.5]

# Encodings and folds.
ENCODING_ALPHA = 10.0
N_FOLDS = 5
SEED = 42

# Behavioural features.
ZSCORE_EPSILON = 1e-9
COLDSTART_MIN_HISTORY = 3

# Costs in USD and thresholds.
FN_COST = 450.0
FP_COST = 35.0
TP_COST = 5.0
TN_COST = 0.0
DEFAULT_THRESHOLD = 0.5
TUNED_THRESHOLD = 0.08
COST_MULTIPLIERS = [0.8, 0.9, 1.0, 1.1, 1.2]

# Drift and degradation.
PSI_BINS = 10
PSI_EPSILON = 1e-6
PSI_ALERT = 0.2
DEGRADATION_ALERT = 0.05
PERFORMANCE_WINDOW = 1000

# Split boundaries in seconds after the anchor.
TRAIN_END = 86400 * 121
VAL_END = 86400 * 151
ANCHOR = "2017-12-01T00:00:00+00:00"

# Share of missing values above which an indicator is emitted.
MISSING_THRESHOLD = 0.05

# Free mail providers.
FREE_PROVIDERS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "mail.com",
    "protonmail.com", "tutanota.com", "zoho.com", "yandex.com", "gmx.com", "live.com", "msn.com",
    "me.com", "mac.com", "fastmail.com", "hushmail.com", "inbox.com", "rocketmail.com",
    "rediffmail.com", "mail.ru", "qq.com", "163.com", "126.com",
]

# Disposable mail providers.
DISPOSABLE_PROVIDERS = [
    "guerrillamail.com", "tempmail.com", "10minutemail.com", "mailinator.com", "throwawaymail.com",
    "yopmail.com", "dispostable.com", "getnada.com", "tempinbox.com", "mintemail.com",
    "sharklasers.com", "maildrop.cc", "tempr.email", "trashmail.com", "fakemailgenerator.com",
]

# Feature time-to-live, first match wins (seconds).
DEFAULT_TTL = 604800
TTL_PATTERNS = [
    ("*_velocity_1h", 3600),
    ("*_velocity_24h", 86400),
    ("*_velocity_7d", 604800),
    ("*_amt_*_30d", 2592000),
    ("*_v_ewm_lambda_*", 604800),
    ("*_fraud_v_ewm_lambda_*", 604800),
    ("is_coldstart_*", 604800),
    ("pagerank_*", 86400),
    ("connected_component_*", 86400),
    ("entity_degree_*", 86400),
    ("*_target_enc_*", 86400),
]
FEATURE_NAME_PATTERN = "^[A-Za-z0-9_.-]{1,128}$"

# Defaults for features missing at scoring time.
ENTITY_DEFAULT = 0.0
BATCH_DEFAULTS = {
    "pagerank_score": 0.0001,
    "connected_component_size": 1.0,
    "clustering_coefficient": 0.0,
    "fraud_neighbor_rate": 0.035,
    "entity_degree_default": 0.0,
}

# Reason texts for contributions that raise the score.
REASON_HIGH = {
    "log_amount": "Transaction amount is unusually large for this customer profile",
    "hour_of_day": "Transaction occurred at an unusual time of day",
    "P_emaildomain_is_free": "Purchaser is using a free email provider, which carries elevated fraud rates",
    "P_emaildomain_is_disposable": "Purchaser email domain is a known disposable / throwaway provider",
    "R_emaildomain_is_free": "Recipient is using a free email provider, which carries elevated fraud rates",
    "card1_velocity_24h": "Unusually high transaction frequency on this card in the last 24 hours",
    "card1_velocity_7d": "Unusually high transaction frequency on this card in the last 7 days",
    "addr1_velocity_24h": "Unusually high transaction frequency from this billing address in the last 24 hours",
    "amt_zscore_vs_card1_history": "Transaction amount unusual compared to your typical spending",
    "time_since_last_txn_zscore": "Transaction timing unusual compared to your typical activity pattern",
    "addr_change_flag": "Transaction is from an address not previously associated with this card",
    "device_change_flag": "Transaction is from a device not previously associated with this account",
    "hour_deviation": "Transaction occurred at an unusual hour for this customer",
    "is_coldstart_card1": "Card has very limited transaction history available",
    "card1_v_ewm_lambda_0.05": "Sustained unusual activity on this card over the last several days",
    "card1_fraud_v_ewm_lambda_0.05": "This card has recent confirmed-fraud activity in its history",
    "card1_v_ewm_lambda_0.5": "Sustained unusual activity on this card in the last several hours",
    "card1_fraud_v_ewm_lambda_0.5": "This card has very recent confirmed-fraud activity",
    "addr1_v_ewm_lambda_0.05": "Sustained unusual activity from this billing address over the last several days",
    "pagerank_score": "This transaction is part of a densely connected entity cluster, a common fraud-ring signature",
    "fraud_neighbor_rate": "Entities in this transaction share connections with previously confirmed fraud",
    "connected_component_size": "This transaction is part of an unusually large entity cluster",
    "entity_degree_card1": "This card is connected to many other entities, exceeding the typical pattern",
    "clustering_coefficient": "The entity-graph neighbourhood for this transaction shows tight interconnection",
}
# Reason texts for contributions that lower the score.
REASON_LOW = {"log_amount": "Transaction amount is on the low end of typical spending"}

# Monitoring histogram bounds (latency in seconds, score in [0, 1]).
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25]
SCORE_BOUNDS = [0.0, 0.01, 0.05, 0.08, 0.1, 0.2, 0.5, 0.8, 1.0]
