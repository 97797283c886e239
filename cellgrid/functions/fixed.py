"""Names, constants, texts and formats that results must reproduce as they are."""

# Activity columns of a call-detail file, and the file-name pattern of the daily files.
ACTIVITY_COLUMNS = ("smsin", "smsout", "callin", "callout", "internet")
DAILY_FILE_PATTERN = "sms-call-internet-mi-*.csv"

# Column-name fragments that identify the cell and the time column of a raw file.
CELL_NAME_PART = "cell"
TIME_NAME_PARTS = ("time", "date")

# Grid and rule constants.
GRID_SIZE = 100
CONGESTION_PERCENTILE = 90
NEIGHBOR_FRACTION = 0.3
SEASON_HOURS = 24
HORIZONS = (1, 2, 3, 4)
AMOUNT_TOLERANCE = 1e-6
KNOWN_HOLIDAYS = ("2013-11-01",)

# Landmark cells whose published patterns validate a load.
UNIVERSITY_CELL = 4259
NIGHTLIFE_CELL = 4456
CENTRE_CELL = 5060

# Validation thresholds and labels.
EVENING_HOURS = (18, 23)
DAYTIME_HOURS = (6, 17)
CENTRE_MIN_PERCENTILE = 90
PASS, UNEXPECTED, WEAK = "PASS", "UNEXPECTED", "WEAKER THAN EXPECTED"

# Forecasting constants.
LAGS = (1, 2, 3, 24)
GENERIC_LAGS = (1, 24, 168)
TRAIN_DAYS = 5
TREES, LEARNING_RATE, MIN_LEAF_ROWS, SEED = 60, 0.05, 50, 42
LEAVES = 15
HOTSPOT_QUANTILE = 0.98
TOP_FEATURES = 6
LABEL_TYPICAL = "Typical cells"
LABEL_HOTSPOT = "Hotspot cells (top 2%)"

# Classes and reason texts of the diagnosis.
ROUTINE, ANOMALOUS = "ROUTINE", "ANOMALOUS"
REASON_HOLIDAY_TARGET = "target date is a known holiday"
REASON_NEIGHBORS = "{hits}/{total} neighbors also at risk"
REASON_HOLIDAY_SOURCE = "isolated, AND forecast is based on a holiday — basis may be unreliable"
REASON_ISOLATED = "isolated — only {hits}/{total} neighbors at risk"

# Report texts.
REPORT_SOURCE = "{amount} units from Cell {source}"
REPORT_NO_SOURCE = "no reallocation possible — insufficient nearby spare capacity"
REPORT_ROUTINE = (
    "[MOCK] Cell {cell} is forecasted to exceed its normal traffic threshold at {time} ({reason}). "
    "Recommended action: {action}. This covers {pct}% of the predicted deficit. "
    "Classified ROUTINE — safe for automatic handling, logged for audit."
)
REPORT_ANOMALOUS = (
    "[MOCK] Cell {cell} is forecasted to exceed its normal traffic threshold at {time}, "
    "but this does not match a routine, explainable pattern ({reason}). "
    "No automatic reallocation was attempted. "
    "ESCALATED — recommend manual investigation before any action is taken."
)
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
CASE_LABEL = "Cell {cell} @ {time} (id {id})"
DEFAULT_CASE_LIMIT = 20
SAMPLE_ROWS = 10
SAMPLES_PER_CLASS = 3
