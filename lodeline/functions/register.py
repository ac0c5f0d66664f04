"""The text functions under names of their own in SQL, for the life of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bodies are SQL, so Catalyst inlines them: no call leaves the JVM.
FUNCTIONS = {
    "lodeline_strip(t STRING) RETURNS STRING": r"regexp_replace(t, r'(?U)^\s+|\s+$', '')",
    "lodeline_normalise(t STRING) RETURNS STRING": r"trim(regexp_replace(lower(t), r'(?U)\s+', ' '))",
    "lodeline_tokens(t STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(t), r'[\p{L}\p{N}]{2,}', 0)",
    "lodeline_chunks(t STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(t, r'(?s).{1,5}', 0)",
    "lodeline_safe_id(t STRING) RETURNS STRING": r"substr(regexp_replace(t, r'(?U)\W+', ''), 1, 20)",
    "lodeline_content_hash(t STRING) RETURNS STRING": "substr(md5(t), 1, 12)",
    "lodeline_host(u STRING) RETURNS STRING": r"regexp_extract(u, r'^https?://([^/]+)', 1)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
