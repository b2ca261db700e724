"""Table schemas of the document lake, and their declared rules."""

from __future__ import annotations

from pyspark.sql import types as T


# type names that the schemas below use; a session is not needed to build them
TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "map": T.MapType(T.StringType(), T.StringType()),
}


def struct_of(spec: str) -> T.StructType:
    """StructType of ``name type, name type, ...``."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in fields])


USERS = struct_of("id string, email string, created_at timestamp")

ITEMS = struct_of(
    "id string, user_id string, url string, title string, site string, status string, "
    "created_at timestamp, updated_at timestamp"
)

CONTENTS = struct_of(
    "item_id string, raw_html string, raw_text string, clean_html string, clean_text string, "
    "lang string, extracted_at timestamp, checksum string"
)

TAGS = struct_of("id string, user_id string, name string")

ITEM_TAGS = struct_of("item_id string, tag_id string")

JOBS = struct_of(
    "id string, kind string, item_id string, status string, run_at timestamp, attempts int, "
    "max_attempts int, backoff_seconds int, payload string, visibility_till timestamp, "
    "reserved_by string, last_error string, created_at timestamp, updated_at timestamp"
)

RESPONSES = struct_of(
    "url string, status int, headers map, declared_length bigint, body binary, "
    "fetched_at timestamp"
)

TABLES = {
    "users": USERS,
    "items": ITEMS,
    "contents": CONTENTS,
    "tags": TAGS,
    "item_tags": ITEM_TAGS,
    "jobs": JOBS,
}

# Status domains and job defaults.
ITEM_STATUS = ("pending", "fetched", "archived")
JOB_STATUS = ("queued", "running", "succeeded", "failed")
DEFAULT_MAX_ATTEMPTS = 25
DEFAULT_LEASE_SECONDS = 300
DEFAULT_BASE_BACKOFF_SECONDS = 30

# (child table, child column, parent table, parent column, action on parent delete)
FOREIGN_KEYS = (
    ("items", "user_id", "users", "id", "cascade"),
    ("contents", "item_id", "items", "id", "cascade"),
    ("tags", "user_id", "users", "id", "cascade"),
    ("item_tags", "item_id", "items", "id", "cascade"),
    ("item_tags", "tag_id", "tags", "id", "cascade"),
    ("jobs", "item_id", "items", "id", "set null"),
)

UNIQUE_KEYS = {
    "users": [("email",)],
    "tags": [("user_id", "name")],
    "item_tags": [("item_id", "tag_id")],
    "contents": [("item_id", "checksum")],
}

NOT_NULL = {
    "users": ["id", "email", "created_at"],
    "items": ["id", "user_id", "url", "status", "created_at", "updated_at"],
    "contents": ["item_id"],
    "tags": ["id", "user_id", "name"],
    "item_tags": ["item_id", "tag_id"],
    "jobs": [
        "id", "kind", "status", "run_at", "attempts", "max_attempts", "backoff_seconds",
        "payload", "created_at", "updated_at",
    ],
}
