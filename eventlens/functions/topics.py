"""Topic filters, source templates and payload decoders as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.scalars import parse_marked, strict_value


#: Payload formats other than JSON.
FORMATS = ("raw", "hex", "csv")


def topic_regex(topic_filter: str) -> str:
    """Regex whose groups are the ``+`` levels, then the ``#`` tail if any.

    ``+`` is one level, ``#`` is all remaining levels (possibly none) and ends
    the filter at once, other levels are literal.
    """
    out = ""
    for i, level in enumerate(topic_filter.split("/")):
        slash = "/" if i else ""
        if level == "#":
            return rf"(?s)^{out}(?:{slash}(.*))?\z" if i else r"(?s)^(.*)\z"
        out += slash + ("([^/]*)" if level == "+" else re.escape(level))
    return rf"(?s)^{out}\z"


def topic_groups(topic_filter: str) -> tuple[int, bool]:
    """How many ``+`` captures there are, and whether a tail is captured."""
    pluses = 0
    for level in topic_filter.split("/"):
        if level == "#":
            return pluses, True
        pluses += level == "+"
    return pluses, False


def topic_matches(topic: Column, topic_filter: str) -> Column:
    if not {"+", "#"} & set(topic_filter.split("/")):
        return topic == F.lit(topic_filter)
    return topic.rlike(topic_regex(topic_filter))


def template_pieces(topic_filter: str, template: str) -> list[str | int] | None:
    """A template's literals and captures (the N-th ``+``, or 0 for the tail).

    None when the template names anything else, or a capture the filter lacks; it then
    fails for every message.
    """
    pluses, has_tail = topic_groups(topic_filter)
    pieces: list[str | int] = []
    for literal, placeholder in re.findall(r"([^{]*)(\{[^}]*\}?)?", template):
        if literal:
            pieces.append(literal)
        if not placeholder:
            continue
        body = re.fullmatch(r"\{(?:(#)|\+(\d+))\}", placeholder)
        if body is None:
            return None
        group = 0 if body[1] else int(body[2])
        if body[1] and not has_tail or body[2] and not 1 <= group <= pluses:
            return None
        pieces.append(group)
    return pieces


def source_from_topic(topic: Column, topic_filter: str, template: str) -> Column | None:
    """Source id built from the captures; None when the template cannot apply.

    ``{+N}`` is the N-th ``+`` level and ``{#}`` the tail.
    """
    pieces = template_pieces(topic_filter, template)
    if pieces is None:
        return None
    regex, tail = topic_regex(topic_filter), topic_groups(topic_filter)[0] + 1
    parts = [F.lit(p) if isinstance(p, str) else F.regexp_extract(topic, regex, p or tail) for p in pieces]
    return F.concat(*parts) if parts else F.lit("")


def csv_fields(text: Column) -> Column:
    """Fields of the first line.

    A quote opens only at the start of a field; inside, two quotes stand for
    one; text after the closing quote is kept.  The line gets a leading comma so
    that every field is one non-empty match of "comma, field".
    """
    first = F.substring_index(text, "\n", 1)
    ends = F.contains(text, F.lit("\n"))  # a bare "\r" without it belongs to the last field
    line = F.when(ends, F.regexp_replace(first, r"\r\z", "")).otherwise(first)
    quoted = r'"(?:[^"]|"")*+(?:"|$)'
    pattern = rf"(?s)\G,((?:{quoted})?+[^,]*)"
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(pattern), F.lit(1))
    parts = r'(?s)^"((?:[^"]|"")*+)"?(.*)$'

    def unquote(field: Column) -> Column:
        inner = F.replace(F.regexp_extract(field, parts, 1), F.lit('""'), F.lit('"'))
        text = F.concat(inner, F.regexp_extract(field, parts, 2))
        return F.when(field.startswith('"'), text).otherwise(field)

    has_quote = F.contains(line, F.lit('"'))
    return F.when(has_quote, F.transform(fields, unquote)).otherwise(F.split(line, ",", -1))


def payload_text(payload: Column) -> Column:
    """Text of a payload; null where its bytes are not UTF-8."""
    text = payload.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def encode_payload(fmt: str, payload: Column) -> Column:
    """Compact JSON text describing a payload that is not JSON itself."""
    if fmt == "raw":
        body = F.regexp_replace(F.base64(payload), r"[=\r\n]", "")
        return F.to_json(F.struct(body.alias("bytes_base64"), F.lit("raw").alias("encoding")))
    if fmt == "hex":
        return F.to_json(
            F.struct(F.lit("hex").alias("encoding"), F.lower(F.hex(payload)).alias("hex"))
        )
    if fmt == "csv":
        text = payload_text(payload)
        return F.when(
            text.isNotNull(),
            F.to_json(F.struct(F.lit("csv").alias("encoding"), csv_fields(text).alias("fields"))),
        )
    raise ValueError(f"unknown payload format {fmt!r}")


def decode_payload(fmt: str, payload: Column) -> Column:
    """Compact JSON text of a binary payload; null where it cannot be decoded."""
    if fmt == "json":
        return F.to_json(strict_value(parse_marked(payload_text(payload))))
    return encode_payload(fmt, payload)


def string_at(node: Column, path: str) -> Column:
    """String found at a simple ``$.a.b[0]`` path; null for any other type."""
    if not re.fullmatch(r"\$(?:\.[A-Za-z_][A-Za-z0-9_]*|\['[^']*'\]|\[\d+\])*", path):
        raise ValueError(f"unsupported path {path!r}: use names and array positions only")
    found = F.try_variant_get(node, path, "variant")
    is_text = F.schema_of_variant(found) == "STRING"
    return F.when(is_text, F.try_variant_get(node, path, "string"))
