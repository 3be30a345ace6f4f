"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 digits of time-sortable ids.
ID_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # what conv() writes in base 32
_DAY_MS = 86_400_000


def bare_kind(kind: Column) -> Column:
    """``name`` of ``name@vN``, without judging validity."""
    return F.substring_index(kind, "@", 1)


def _is_valid_ref(kind: Column) -> Column:
    at = F.instr(kind, "@")
    return (F.length(kind) > 0) & ((at == 0) | ((at > 1) & (at < F.length(kind))))


def kind_name(kind: Column) -> Column:
    """Name part of a kind reference; null where the reference is invalid."""
    return F.when(_is_valid_ref(kind), bare_kind(kind))


def kind_version(kind: Column) -> Column:
    """Pinned version, null when none is pinned or the reference is invalid."""
    at = F.instr(kind, "@")
    return F.when(_is_valid_ref(kind) & (at > 0), F.substr(kind, at + 1))


def day_of(ts_ms: Column) -> Column:
    """UTC calendar day, computed without the session zone."""
    days = (ts_ms - F.pmod(ts_ms, F.lit(_DAY_MS))) / F.lit(_DAY_MS)
    return F.date_from_unix_date(days.cast("int"))


def generated_id(ts_ms: Column, *parts: Column) -> Column:
    """Deterministic time-sortable id: ten digits of time, sixteen of a hash.

    Being a pure function of the row, a retried task produces the same id.
    """
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digest = F.sha2(F.concat_ws("\x1f", *texts), 256)
    plain = F.concat(
        F.lpad(F.conv(ts_ms.cast("string"), 10, 32), 10, "0"),
        F.lpad(F.conv(F.substring(digest, 1, 10), 16, 32), 8, "0"),
        F.lpad(F.conv(F.substring(digest, 11, 10), 16, 32), 8, "0"),
    )
    return F.translate(plain, _CONV_DIGITS, ID_ALPHABET)


def id_time_ms(event_id: Column) -> Column:
    """Milliseconds that the first ten digits of a time-sortable id name; null for any other id."""
    digits = F.translate(F.substring(event_id, 1, 10), ID_ALPHABET, _CONV_DIGITS)
    told = F.conv(digits, 32, 10).cast("long")
    return F.when(event_id.rlike(f"^[0-7][{ID_ALPHABET}]{{25}}$"), told)


_END = "\\u0000end"  # as written in JSON; marks where a text must stop


def parse_marked(json_text: Column) -> Column:
    """First half of strict parsing: the text as first of two list items.

    ``try_parse_json`` stops after the first value and ignores what follows.  So
    the text is put before an end mark, and `strict_value` looks whether the
    mark is found where it belongs.  Keep the result in a column of its own;
    used twice in one expression it would be parsed twice.
    """
    return F.try_parse_json(F.concat(F.lit("["), json_text, F.lit(f',"{_END}"]')))


def strict_value(marked: Column) -> Column:
    """The value if the text was exactly one JSON value, else null."""
    at_end = F.try_variant_get(marked, "$[1]", "string") == "\0end"
    return F.when(at_end, F.try_variant_get(marked, "$[0]", "variant"))


def utf8_cut(text: Column, max_bytes: int) -> Column:
    """Longest prefix of at most ``max_bytes`` bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")

    def inside(pos: int) -> Column:
        return F.hex(F.substring(raw, pos, 1)).between("80", "BF")

    keep = (
        F.when(~inside(max_bytes + 1), max_bytes)
        .when(~inside(max_bytes), max_bytes - 1)
        .when(~inside(max_bytes - 1), max_bytes - 2)
        .otherwise(max_bytes - 3)
    )
    cut = F.decode(F.substr(raw, F.lit(1), keep), "UTF-8")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(cut)


def was_cut(text: Column, max_bytes: int) -> Column:
    return F.octet_length(text) > max_bytes


def semantic_size(json_text: Column) -> Column:
    """Estimated payload size of a JSON text.

    null 4, boolean 5, number 16, string bytes + 2, array sum + 2, object
    sum of (key bytes + 4 + value) + 2.  A key costs its quoted length plus two
    for the colon, so the estimate is a sum over the lexical pieces of the text
    and needs no tree walk: escapes are first replaced by plain characters of
    the same decoded byte length, then strings are measured and removed and the
    remaining pieces are counted.
    """
    plain = json_text
    for pattern, stand_in in [
        (r"\\\\", "x"),
        (r"\\u00[0-7][0-9a-fA-F]", "x"),
        (r"\\u0[0-7][0-9a-fA-F]{2}", "xx"),
        (r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}", "xx"),
        (r"\\u[0-9a-fA-F]{4}", "xxx"),
        (r"\\.", "x"),
    ]:
        plain = F.regexp_replace(plain, pattern, stand_in)
    plain = F.when(F.instr(json_text, "\\") > 0, plain).otherwise(json_text)

    def weighed(plain: Column, rest: Column) -> Column:
        def count(pattern: str) -> Column:
            return F.regexp_count(rest, F.lit(pattern))

        return (
            F.octet_length(plain)
            - F.octet_length(rest)
            + count(r"[:{\[]") * 2
            + count(r"null") * 4
            + count(r"true|false") * 5
            + count(r"-?[0-9][0-9.eE+-]*") * 16
        ).cast("long")

    # an element of an array is evaluated once, however often the function names it
    pieces = F.transform(F.array(plain), lambda p: F.struct(p.alias("plain"), F.regexp_replace(p, '"[^"]*"', "").alias("rest")))
    return F.transform(pieces, lambda p: weighed(p["plain"], p["rest"]))[0]
