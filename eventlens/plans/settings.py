"""The configuration used by the registered queries."""

from __future__ import annotations

from eventlens.model import RetentionPolicy, Subscription, TokenScope, VectorFilter, WindowFilter
from eventlens.operators.normalize import KindSchema, SchemaBook
from eventlens.sources.tables import DAY_MS, NOW_MS

WEEK = WindowFilter(
    NOW_MS - 20 * DAY_MS, NOW_MS - 13 * DAY_MS, ("user.1*",), ("click",), limit=100
)
GLOBBED = WindowFilter(
    NOW_MS - 30 * DAY_MS, NOW_MS, ("user.?[05]", "user.1{2,3}"), ("view*", "error")
)
TOKENS = [
    TokenScope("edge0", ("*",), ("message",), "1/s"),
    TokenScope("edge1", ("chat.user", "chat.assistant"), ("mess*",)),
    TokenScope("edge2", ("chat.user",), ("message",), "2/m"),
]
HARD_CAP, SOFT_CAP = 700, 300
POLICIES = [
    RetentionPolicy(match_kind="click", max_age_ms=20 * DAY_MS, max_count=5),
    RetentionPolicy(match_source_id="user.1", max_count=3),
    RetentionPolicy(match_source_id="user.2", match_kind="view", max_bytes=60),
    RetentionPolicy(max_age_ms=25 * DAY_MS, max_bytes=70, vector_max_age_ms=15 * DAY_MS),
    RetentionPolicy(match_kind="error", vector_max_age_ms=5 * DAY_MS),
]
HOT_POLICIES = [
    RetentionPolicy(match_kind="click", max_age_ms=25 * DAY_MS, max_count=300),
    RetentionPolicy(match_kind="view", max_bytes=3000),
    RetentionPolicy(max_age_ms=10 * DAY_MS, max_count=400, max_bytes=5000),
]
SUBSCRIPTIONS = [
    Subscription("site/click/user/+", "click.{+1}", kind="click"),
    Subscription("site/view/#", "view/{#}", kind="view", payload="csv"),
    Subscription("site/error/user/+", "error.{+1}", kind="error", payload="hex"),
    Subscription("site/signup/+/+", "{+1}.{+2}", kind="signup", payload="raw"),
    Subscription("site/+/user/+", "{+1}.{+2}", kind_field="$.type"),
]
_COUNTED = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}
SCHEMAS = SchemaBook(
    sources={"user.3": {**_COUNTED, "properties": {"k": {"maximum": 50}}}},
    kinds=[
        KindSchema("click", "v1", {**_COUNTED, "properties": {"k": {"minimum": 40}}}),
        KindSchema("click", "v2", {**_COUNTED, "properties": {"k": {"minimum": 20}}}),
        KindSchema("view", "v1", _COUNTED),
        KindSchema("view", "v2"),
        KindSchema("error", "v1", {**_COUNTED, "required": ["k", "code"]}),
    ],
)
MESSAGES = SchemaBook(
    sources={"chat.user": {"type": "object", "properties": {"text": {"maxLength": 100}}}},
    kinds=[KindSchema("message", "v1", {"type": "object", "properties": {"text": {"type": "string", "maxLength": 150}}})],
)
QUERY_TEXT = "front door opened while nobody was home"
NEARBY = VectorFilter(
    NOW_MS - 25 * DAY_MS, NOW_MS - 5 * DAY_MS, ("user.*",), ("click", "view", "view@v2")
)
RING_EVENTS, RING_AGE_MS = 5, 3 * DAY_MS
RECENT_MS = NOW_MS - 2 * DAY_MS
