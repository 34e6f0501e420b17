"""Table schemas shared by sources, operators and plans."""

POINT = "struct<lat:double,lon:double>"
PLACE = f"struct<name:string,point:{POINT},radius_deg:double,bbox:array<double>>"
FACTS = "array<struct<k:string,v:string>>"

RAW_PAYLOADS = (
    "source_id string, fetched timestamp, http_status int, latency_ms bigint, error string, body string"
)

DRAFT_COLUMNS = [
    ("source_id", "string"),
    ("fetched", "timestamp"),
    ("kind", "string"),
    ("title", "string"),
    ("snippet", "string"),
    ("url", "string"),
    ("published", "timestamp"),
    ("place", PLACE),
    ("severity", "int"),
    ("category_override", "string"),
    ("facts", FACTS),
    ("event_key", "string"),
    ("thumbnail", "string"),
]

ITEM_COLUMNS = [
    ("id", "string"),
    ("kind", "string"),
    ("source", "string"),
    ("title", "string"),
    ("snippet", "string"),
    ("url", "string"),
    ("published", "timestamp"),
    ("fetched", "timestamp"),
    ("category", "string"),
    ("severity", "int"),
    ("place", PLACE),
    ("tokens", "array<string>"),
    ("facts", FACTS),
    ("relevance", "bigint"),
    ("event_key", "string"),
    ("thumbnail", "string"),
    ("language", "string"),
    ("anchor_id", "string"),
]


def ddl(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns)


ITEMS = ddl(ITEM_COLUMNS)
DRAFTS = ddl(DRAFT_COLUMNS)
