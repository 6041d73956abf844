"""Fixed schemas (as DDL) of the tables the library reads and writes. ``repo_id`` leads every key."""

CATALOG = "repo_id STRING, rel_path STRING, name STRING, ext STRING, length BIGINT, mtime TIMESTAMP, hash STRING"
SYMBOLS = (
    "repo_id STRING, file STRING, line INT, type STRING, name STRING, "
    "type_ord INT, pos BIGINT, cell INT, block STRING"
)
CONTENT_META = "repo_id STRING, rel_path STRING, hash STRING, last_updated TIMESTAMP, summary STRING"
IGNORE_PATTERNS = "repo_id STRING, pattern STRING, is_dir BOOLEAN, source STRING"
LANG_RULES = "lang STRING, type STRING, type_ord INT, regex STRING, rule_no INT"
NOTEBOOK = "cells ARRAY<STRUCT<cell_type: STRING, source: STRING>>"
BATCH_ASKED = "custom_id STRING, repo_id STRING, rel_path STRING, hash STRING"
BATCH_RESULT = (
    "custom_id STRING, "
    "response STRUCT<body: STRUCT<choices: ARRAY<STRUCT<message: STRUCT<content: STRING>>>>>"
)
BATCH_ERROR = "custom_id STRING, error STRUCT<code: STRING, message: STRING>"
BATCH_JOBS = (
    "batch_id STRING, input_file_id STRING, chunk_index INT, total_chunks INT, "
    "created_at DOUBLE, completion_window STRING"
)
SYMBOL_HISTORY = SYMBOLS + ", kind STRING, snapshot_ts TIMESTAMP"
CONTENT_HISTORY = CONTENT_META + ", kind STRING, snapshot_ts TIMESTAMP"
