"""Chat formatting: a role automaton checks the turn order, a declarative template writes segments with loss flags.

Turns of a conversation are ordered by (turn, role, text); the automaton folds over the roles.  Control strings
inside texts are escaped reversibly, so that no text can forge a turn and the formatted string parses back.

Null text or role: empty.  Null conv_id is a conversation of its own.  Repeated rows are turns of their own.  An
empty conversation does not exist (there are no rows for it); an empty table gives no rows.  A conversation is one output
row, so even a very long one has to fit in a task, as any document has to; nothing larger than a conversation is gathered.
Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Template:
    """Headers of the known roles, the end of a turn, the roles under loss, and the automaton.

    ``escapes`` are (control string, escape) pairs.  The first escapes the escape character itself; reading back
    undoes them in reverse.  No control string may occur in what escaping gives.
    ``moves`` maps state -> {role: next state}; a conversation is valid if all moves exist and it ends in ``final``.
    """

    headers: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "}
    )
    other: str = "### Role "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\e"), ("</turn>", "\\t"), ("###", "\\h"))
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def escape(self, text: Column) -> Column:
        for raw, code in self.escapes:
            text = F.replace(text, F.lit(raw), F.lit(code))
        return text

    def unescape(self, text: Column) -> Column:
        for raw, code in reversed(self.escapes):
            text = F.replace(text, F.lit(code), F.lit(raw))
        return text

    def header(self, role: Column) -> Column:
        """A known role has its own header; any other is escaped and ends with a line end, itself escaped."""
        other = F.concat(F.lit(self.other), F.replace(self.escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
        out = None
        for name, text in self.headers.items():
            out = (F if out is None else out).when(role == name, F.lit(text))
        return other if out is None else out.otherwise(other)

    def parse_turn(self, piece: Column) -> Column:
        """struct(role, text) of what stands before an end mark."""
        body = F.substr(piece, F.lit(len(self.other) + 1))
        line = F.instr(body, "\n")
        role = self.unescape(F.replace(F.substr(body, F.lit(1), line - 1), F.lit("\\n"), F.lit("\n")))
        out = F.struct(role.alias("role"), self.unescape(F.substr(body, line + 1)).alias("text"))
        for name, text in self.headers.items():
            own = F.struct(F.lit(name).alias("role"), self.unescape(F.substr(piece, F.lit(len(text) + 1))).alias("text"))
            out = F.when(F.startswith(piece, F.lit(text)), own).otherwise(out)
        return out

    def state_after(self, roles: Column) -> Column:
        """Fold the automaton over an array of roles; null once a move is missing."""

        def step(state: Column, role: Column) -> Column:
            out = None
            for source, targets in self.moves.items():
                for name, target in targets.items():
                    out = (F if out is None else out).when((state == source) & (role == name), F.lit(target))
            return F.lit(None).cast("string") if out is None else out

        return F.aggregate(roles, F.lit(self.start), step)


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, valid, formatted, segments (array of struct(text, loss)) from rows (conv_id, turn, role, text)."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    turns = rows.select("conv_id", F.struct("turn", blank("role"), blank("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def parts(t: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(template.header(t["role"]), F.lit(False)),
            seg(template.escape(t["text"]), t["role"].isin(*template.loss_roles)),
            seg(F.lit(template.end), F.lit(False)),
        )

    out = turns.select("conv_id", template.state_after(F.transform("turns", lambda t: t["role"])).alias("state"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return out.select(
        "conv_id",
        F.coalesce(F.col("state").isin(*template.final), F.lit(False)).alias("valid"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array of struct(role, text) from a formatted string."""
    pieces = F.split(formatted, r"\Q" + template.end + r"\E", -1)
    return let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), template.parse_turn))


def loss_text(segments: Column, template: Template = Template()) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


def op2_chat_format(spark, sf_dir):
    probe = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    template = Template()
    chats = format_chats(rows.unionByName(extra), template)
    back = chats.select(
        "conv_id", "valid", read_back(F.col("formatted"), template).alias("turns"), loss_text(F.col("segments"), template).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


OP2_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\e'), '</turn>', '\t'), '###', '\h') AS x,
  CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 WHEN 'tool' THEN 10 END AS h,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nxt FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(h + length(x) + 8) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user'
    WHEN prev IN ('user', 'tool') THEN role = 'assistant' WHEN prev = 'assistant' THEN role IN ('user', 'tool') ELSE false END
    AND (nxt IS NOT NULL OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""
