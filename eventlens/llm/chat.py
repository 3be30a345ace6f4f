"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A template says, as data, which turns may follow which (`moves`), what stands around a turn's text and
which roles' texts count for the loss. Every conversation is formatted, in order of its turns; `valid` says whether its
roles follow the machine to an accepting state, and `stopped_at` names the first turn that does not.

Formatted, a turn is a header with the role, the escaped text and an end mark. Escapes replace
control strings and the escape character itself, so formatted texts hold control strings only where the template put
them, and `turns_of` gives back roles and texts exactly. `segments` are the pieces in order with a loss flag each;
their texts make up `formatted`.

Nulls: a null text or role is empty (no machine state takes an empty role); rows without conv_id are one
conversation; turns without number come first. Rows of one turn are ordered by role and text, repeated ones stay.
Other columns are ignored. An empty table gives an empty result. A conversation is one row of the result, so it
has to fit a task, as its digest requires anyway.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import let, table


@dataclass(frozen=True)
class Template:
    header: str = "### "
    after_role: str = ": "
    end: str = "</turn>\n"
    escape: str = "\\"
    #: control string or escape character -> its code after the escape character; the escape character is first
    codes: dict[str, str] = field(default_factory=lambda: {"\\": "b", "###": "h", "</turn>": "e"})
    #: further codes inside a role
    role_codes: dict[str, str] = field(default_factory=lambda: {":": "c"})
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)


CHAT = Template()
_REFUSED = "refused"


def escaped(text: Column, codes: dict[str, str], escape: str) -> Column:
    for control, code in codes.items():
        text = F.replace(text, F.lit(control), F.lit(escape + code))
    return text


def unescaped(text: Column, codes: dict[str, str], escape: str) -> Column:
    """Undoes `escaped`: every escape character left is the start of a code, its own comes last."""
    for control, code in reversed(codes.items()):
        text = F.replace(text, F.lit(escape + code), F.lit(control))
    return text


def walk(roles: Column, template: Template) -> Column:
    """(state, stopped_at) after the roles; `stopped_at` is null if every turn had a move."""
    table_ = F.create_map(*(F.lit(x) for (a, b), c in template.moves.items() for x in (f"{a} {b}", c)))
    start = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("stopped_at"), F.lit(0).alias("at"))

    def step(s: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table_, F.concat_ws(" ", s["state"], role)), F.lit(_REFUSED))
        stop = F.coalesce(s["stopped_at"], F.when(to == _REFUSED, s["at"]))
        return F.struct(to.alias("state"), stop.alias("stopped_at"), (s["at"] + 1).alias("at"))

    return F.aggregate(roles, start, step)


def formatted(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation: `conv_id`, `n_turns`, `valid`, `stopped_at`, `segments`, `formatted`.

    `rows` has `conv_id`, `turn`, `role`, `text`.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    role_codes = template.codes | template.role_codes

    def pieces(t: Column) -> Column:
        head = F.concat(
            F.lit(template.header), escaped(t["role"], role_codes, template.escape), F.lit(template.after_role)
        )
        body = escaped(t["text"], template.codes, template.escape)
        flags = [F.lit(False), t["role"].isin(*template.loss_roles), F.lit(False)]
        texts = [head, body, F.lit(template.end)]
        return F.array(*(F.struct(x.alias("text"), f.alias("loss")) for x, f in zip(texts, flags, strict=True)))

    talks = talks.withColumns(
        {
            "segments": F.flatten(F.transform("turns", pieces)),
            "walked": walk(F.transform("turns", lambda t: t["role"]), template),
        }
    )
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.col("walked.state").isin(*template.accepting).alias("valid"),
        F.col("walked.stopped_at").alias("stopped_at"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def turns_of(text: Column, template: Template = CHAT) -> Column:
    """Roles and texts read back from a formatted conversation, as an array of structs."""
    ends = F.split(text, f"\\Q{template.end}\\E", -1)
    role_codes = template.codes | template.role_codes

    def parsed(piece: Column) -> Column:
        def cut(at: Column) -> Column:
            role = F.substring(piece, F.lit(len(template.header) + 1), at - 1 - len(template.header))
            body = F.substring(piece, at + len(template.after_role), F.length(piece))
            return F.struct(
                unescaped(role, role_codes, template.escape).alias("role"),
                unescaped(body, template.codes, template.escape).alias("text"),
            )

        return let(F.position(F.lit(template.after_role), piece), cut)

    return let(ends, lambda all_: F.transform(F.slice(all_, F.lit(1), F.size(all_) - 1), parsed))


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, without escapes."""
    texts = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template.codes, template.escape))
    return F.array_join(texts, "")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    done = formatted(talks.unionByName(own))
    turns = F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = done.withColumn("turns", turns).withColumn("loss", loss_text(F.col("segments")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), parts AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') || '</turn>' || chr(10) AS formatted
  FROM rows
), talks AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text) AS roles,
    CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
  FROM parts GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, regexp_full_match(roles, '(system )?user assistant( user assistant)*') AS valid
FROM talks
"""
