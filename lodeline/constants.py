"""Limits that results depend on. Fixed values."""

DETECT_LINES, SCHEMA_LINES = 64, 512
DETECT_BYTES, SCHEMA_BYTES, LEAST_SAMPLE_LINES = 2 << 20, 4 << 20, 6
JSON_SHARE, LEAST_JSON_LINES = 0.9, 3
MAX_COLUMNS, MAX_UNION_COLUMNS, MAX_SOURCES = 16, 24, 8
SEARCH_CAP, DISTINCT_CAP, TOP_VALUES, VOTE_ROWS = 1_000_000, 10_000, 20, 100
LEVEL_HEAD_BYTES = 200
WINDOW_ROWS = 200
MAX_BOOKMARKS, MAX_FILES, MAX_SESSIONS, MAX_EXPANDED, NAME_LENGTH = 256, 64, 12, 1024, 64
LEAST_WIDTH, MOST_WIDTH = 40, 512
COPY_LINES = 100_000
MAX_OFFSET_MS, MAX_ZONE_MS = 10 * 365 * 86_400_000, 23 * 3_600_000
TS_NAMES = ("ts", "timestamp", "time", "@timestamp")
TS_SHARE, EPOCH_MS_FROM = 0.5, 100_000_000_000
LEVEL_NAMES = ("level", "severity", "lvl", "loglevel", "log_level", "priority")
LEVELS = ("FATAL", "ERROR", "WARN", "INFO", "DEBUG", "OTHER")
