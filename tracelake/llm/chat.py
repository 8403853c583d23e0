"""Operator 6, chat formatting, in DataFrame functions alone.

A declarative ``Template`` names the roles' labels, the turn marks and which
roles are trained on.  A finite-state machine over roles validates the order of
turns; a conversation that breaks it is still formatted and carries the first
bad turn's place.  The output holds the formatted string and its segments with
a loss flag each; ``read_back`` parses the formatted string again.

Escapes: inside a turn ``\\`` becomes ``\\b``, ``<`` becomes ``\\l``, ``#``
becomes ``\\h`` (in a role's name also ``:`` becomes ``\\c``), so no control
string, all of which begin with ``<`` or ``#``, can stand in a text, and the
way back is exact.

Defined cases: a null text is empty; a null role is an empty unknown role;
turns sort by turn (nulls first), then role, then text, and repeated rows stay;
a null conversation id is one conversation; no rows give no rows; texts of any length
are kept whole; other columns are not read, whatever their names.  One
conversation is one output row, so its turns meet in one task by definition;
conversations themselves spread by hash of their id.  Where the table has a conversation -7
of its own, the query's two rows are further turns of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like.  ``open`` and ``close`` must begin with # or <."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: tuple[str, ...] = ("assistant",)
    #: state>role -> state; what isn't listed is a fault.
    moves: dict[str, str] = field(default_factory=lambda: {"start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user"})
    final: tuple[str, ...] = ("assistant",)


ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def validate(turns: Column, template: Template) -> Column:
    """struct<state, bad>: the machine's last state and the place (from 1) of the first bad turn, 0 if none."""
    moves = _literal_map(template.moves)

    def step(s, turn):
        to = F.try_element_at(moves, F.concat(s["state"], F.lit(">"), turn["role"]))
        n = s["n"] + 1
        return F.struct(F.coalesce(to, s["state"]).alias("state"), n.alias("n"), F.when(s["bad"] > 0, s["bad"]).when(to.isNull(), n).otherwise(0).alias("bad"))

    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(0).alias("bad")), step)


def format_chat(df: DataFrame, template: Template | None = None, key: str = "conv_id") -> DataFrame:
    """key, formatted, segments array<struct<text, loss>>, is_valid, bad_turn."""
    t = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    labels = _literal_map(t.labels)
    label = F.coalesce(F.try_element_at(labels, role), F.concat(F.lit("?"), escape(role, ROLE_ESCAPES)))
    rows = df.select(F.col(key).alias("k"), F.struct("turn", role.alias("role"), text.alias("raw"), label.alias("label"), escape(text).alias("text")).alias("t"))
    turns = rows.groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = turns.select(
        "k",
        validate(F.col("turns"), t).alias("machine"),
        F.flatten(F.transform("turns", lambda x: F.array(
            F.struct(F.concat(F.lit(t.open), x["label"], F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(x["text"].alias("text"), x["role"].isin(*t.trained).alias("loss")),
            F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
        ))).alias("segments"),
    )
    return whole.select(
        F.col("k").alias(key),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        ((F.col("machine.bad") == 0) & F.col("machine.state").isin(*t.final)).alias("is_valid"),
        F.col("machine.bad").alias("bad_turn"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> parsed from a formatted string."""
    t = template or Template()
    roles = _literal_map({v: k for k, v in t.labels.items()})

    def parse(part):
        head = F.substring_index(part, t.after_role, 1)
        label = F.substr(head, F.lit(len(t.open) + 1))
        body = F.substr(part, F.length(head) + len(t.after_role) + 1)
        known = F.try_element_at(roles, label)
        return F.struct(F.coalesce(known, unescape(F.substr(label, F.lit(2)), ROLE_ESCAPES)).alias("role"), unescape(body).alias("text"))

    parts = F.split(formatted, "\\Q" + t.close + "\\E")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), parse)


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = format_chat(rows.unionByName(more))
    back = out.select("conv_id", "formatted", "is_valid", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "is_valid",
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, lag(role, 1, 'start') OVER w AS before, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS m
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), x AS (
  SELECT *, (before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AND (n < m OR role = 'assistant') AS good,
    CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) END
      + 4 + 2 + 8 + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS size
  FROM s
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars,
  bool_and(good) AS is_valid
FROM x GROUP BY conv_id
"""
