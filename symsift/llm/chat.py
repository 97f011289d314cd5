"""Chat formatting by a declarative template (operator 5), DataFrame functions only.

A finite-state machine over roles checks the order of turns: each role maps the
states it may follow to the next one.  Every turn becomes segments with a loss
flag; the formatted text is their concatenation.  Control strings inside texts
and roles are escaped reversibly: ``c + ESC*n + rest`` becomes
``c + ESC*(n+1) + rest`` for each control string ``c + rest``, so that none is
left and the inverse is exact.

Rows of a conversation are put in order of turn, then role, then text, so ties
and repeated rows have one order.  Null texts and roles count as empty, a null
turn comes first, a null conv_id is a conversation of its own.  An unknown role
or a wrong order makes a conversation invalid, with the first bad turn's place;
it is formatted all the same.  An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + middle + text + close for each turn; ``loss`` roles are trained on."""

    open: str = "[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    loss: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    #: role -> {state before: state after}; the first state is "start", and ``final`` states may end
    machine: dict = field(default_factory=lambda: {"system": {"start": "system"}, "user": {"start": "user", "system": "user", "assistant": "user"}, "assistant": {"user": "assistant"}})
    final: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close)


def escaped(text: Column, t: Template) -> Column:
    for h in sorted({c[0] for c in t.controls}):
        rest = "|".join(re.escape(c[1:]) for c in t.controls if c[0] == h)
        e = re.escape(t.escape)
        text = F.regexp_replace(text, f"{re.escape(h)}({e}*)({rest})", f"{_literal(h + t.escape)}$1$2")
    return text


def unescaped(text: Column, t: Template) -> Column:
    for h in sorted({c[0] for c in t.controls}, reverse=True):
        rest = "|".join(re.escape(c[1:]) for c in t.controls if c[0] == h)
        e = re.escape(t.escape)
        text = F.regexp_replace(text, f"{re.escape(h)}{e}({e}*)({rest})", f"{_literal(h)}$1$2")
    return text


def _literal(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def segments(role: Column, text: Column, t: Template) -> Column:
    """A turn's (text, loss) segments."""
    seg = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    return F.array(
        seg(F.concat(F.lit(t.open), escaped(role, t), F.lit(t.middle)), F.lit(False)),
        seg(escaped(text, t), role.isin(*t.loss)),
        seg(F.lit(t.close), F.lit(False)),
    )


def order_fault(roles: Column, t: Template) -> Column:
    """0 if the machine accepts the roles, else the place (from 1) of the first turn it rejects; one past the end if the end is."""

    def step(acc: Column, role: Column) -> Column:
        after = F.lit(None).cast("string")
        for r, moves in t.machine.items():
            for before, to in moves.items():
                after = F.when((role == r) & (acc["state"] == before), F.lit(to)).otherwise(after)
        live = acc["fault"] == 0
        return F.struct(
            F.when(live & after.isNotNull(), after).otherwise(acc["state"]).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when(live & after.isNull(), acc["at"]).otherwise(acc["fault"]).alias("fault"),
        )

    done = F.aggregate(roles, F.struct(F.lit("start").alias("state"), F.lit(1).alias("at"), F.lit(0).alias("fault")), step)
    return F.when((done["fault"] == 0) & ~done["state"].isin(*t.final), done["at"]).otherwise(done["fault"])


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments array<(text, loss)>, fault, from rows conv_id, turn, role, text."""
    t = template or Template()
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("rows"))
    return chats.select("conv_id", F.flatten(F.transform("rows", lambda r: segments(r["role"], r["text"], t))).alias("segments"), order_fault(F.col("rows.role"), t).alias("fault"))


def read_back(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, turns array<(role, text)>, loss_text: parsed from the output alone."""
    t = template or Template()
    joined = chats.select("*", F.array_join("segments.text", "").alias("formatted"))
    turns = F.filter(F.split("formatted", re.escape(t.close), -1), lambda x: F.length(x) > 0)
    head = lambda x: F.substring_index(F.substring(x, len(t.open) + 1, F.length(x)), t.middle, 1)
    parsed = F.transform(turns, lambda x: F.struct(unescaped(head(x), t).alias("role"), unescaped(F.substring(x, F.length(head(x)) + len(t.open) + len(t.middle) + 1, F.length(x)), t).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
    return joined.select("conv_id", "formatted", parsed.alias("turns"), loss.alias("loss_text"), "fault")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    back = read_back(format_chats(rows.unionByName(own)))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("fault").cast("long").alias("fault"),
    )


ORACLE = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), e AS (
    SELECT *, length(regexp_replace(regexp_replace(text, '\[(\\*)(INST\]|/INST\])', '[\\\1\2', 'g'), '<(\\*)(/s>)', '<\\\1\2', 'g'))
            + length(regexp_replace(regexp_replace(role, '\[(\\*)(INST\]|/INST\])', '[\\\1\2', 'g'), '<(\\*)(/s>)', '<\\\1\2', 'g')) + 17 AS size,
        row_number() OVER w AS place, lag(role) OVER w AS before
    FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
    SELECT *, CASE role WHEN 'system' THEN place = 1 WHEN 'user' THEN place = 1 OR before IN ('system', 'assistant') WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END AS fits
    FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars,
       CAST(coalesce(min(place) FILTER (NOT fits), CASE WHEN arg_max(role, place) = 'assistant' THEN 0 ELSE count(*) + 1 END) AS BIGINT) AS fault
FROM f GROUP BY conv_id
"""
