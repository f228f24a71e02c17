"""Fixed values of the telemetry model.

Everything in this module must equal the behaviour being reproduced: column
layout, feature sensors, window sizes, decision thresholds and the exact
action / label texts.  They are stated once, plainly, and imported elsewhere.
"""

# --- fixed values: raw telemetry layout (26 columns, by position) ---------
ID_COLUMNS = ["unit_id", "time_cycle"]
SETTING_COLUMNS = ["op_setting_1", "op_setting_2", "op_setting_3"]
SENSOR_COLUMNS = [f"sensor_{i}" for i in range(1, 22)]
RAW_COLUMNS = ID_COLUMNS + SETTING_COLUMNS + SENSOR_COLUMNS

# --- fixed values: feature engineering ------------------------------------
SELECTED_SENSORS = ["sensor_2", "sensor_3", "sensor_4", "sensor_11", "sensor_15", "sensor_21"]
ROLLING_WINDOW = 5
SEQUENCE_LENGTH = 30
NON_FEATURE_COLUMNS = ["unit_id", "time_cycle", "RUL"]

# --- fixed values: models and evaluation ----------------------------------
RANDOM_STATE = 42
ANOMALY_N_ESTIMATORS = 100
ANOMALY_CONTAMINATION = 0.05
ANOMALY_MAX_SAMPLES = 256
RUL_N_ESTIMATORS = 100
LSTM_EPOCHS = 30                    # at most; early stopping
AUTOENCODER_RUL_THRESHOLD = 50      # healthy rows: RUL > 50
AUTOENCODER_PERCENTILE = 0.95
GROUND_TRUTH_RUL_THRESHOLD = 15     # true anomaly: RUL <= 15
TEST_SIZE = 0.2
VALIDATION_SPLIT = 0.15

# --- fixed values: decision thresholds ------------------------------------
RUL_CRITICAL = 5
RUL_HIGH_RISK = 15
RUL_CAUTION = 30
RUL_SAFE = 80
ACTION_CAUTION_RUL = 10
SCORE_STRONG_WARNING = -0.10
SCORE_STRONG_ANOMALY = -0.15
RISK_RUL_WEIGHT = 0.60
RISK_ANOMALY_WEIGHT = 0.40
RISK_SCORE_FLOOR = -0.5

# --- fixed values: action texts, in rule order ----------------------------
ACTION_CRITICAL = "CRITICAL: Immediate maintenance required"
ACTION_HIGH_RISK = "HIGH RISK: Schedule urgent inspection"
ACTION_STRONG = "WARNING: Strong anomaly detected"
ACTION_MONITOR = "WARNING: Monitor this unit closely"
ACTION_CAUTION = "CAUTION: Unit nearing failure threshold"
ACTION_NORMAL = "NORMAL: System operating normally"

# --- fixed values: dashboard rules ----------------------------------------
ALERT_WORDS = ["HIGH RISK", "WARNING", "CAUTION"]
HEALTH_GOOD = 70
HEALTH_MEDIUM = 40
RISK_BAND_CRITICAL = 0.7
RISK_BAND_WARNING = 0.4
FAILURE_RISK_MULTIPLIER = 5
RISK_HISTOGRAM_BINS = 30
LIVE_STORE_SIZE = 500
SAMPLE_STREAM_ROWS = 200
DASHBOARD_SAMPLE_ROWS = 5000
TEXT_TRUNCATE_AT = 30
TEXT_TRUNCATE_KEEP = 28
RATE_FLOOR = 0.001
# Default latency-histogram upper bounds (seconds) of the common metrics client.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]

# --- fixed values: offline policy (state = anomaly * 4 + rul band) --------
POLICY_ACTIONS = ["do_nothing", "monitor_closely", "schedule_inspection", "emergency_shutdown"]
Q_GAMMA = 0.9
