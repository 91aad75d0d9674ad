r"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A conversation log is a table of events ``(conv_id, seq, kind, turn, role, text)``:

* ``delta``       appends its text to the message of its turn;
* ``edit``        replaces the message of its turn (later deltas append to the edited text);
* ``regenerate``  discards the message of its turn and every later turn of the conversation so far.

The log is partitioned by conversation, every message is folded in the order of ``seq``, and the final
messages are rendered with a template::

    <|im_start|>ROLE\nTEXT\n<|im_end|>\n

Control strings inside a text get one backslash more than they had, so a rendered text never holds a
bare control string and reading back removes exactly one backslash.

A conversation may hold a third of all rows, so it is cut into parts of ``2**PART_BITS`` turn numbers;
parts are folded and rendered independently and the output has one row per part.  The loss mask of a
part lists the (start, end) code point spans of the assistant texts in that part's string.

Defined cases: null text and null role are empty; roles and texts may hold any character (in a role, a newline and
a backslash are escaped); a null turn sorts first; a null conv_id is a conversation of its own; rows repeated with the same turn are separate messages ordered by (role, text);
a conversation whose messages were all discarded has no row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import load

PART_BITS = 6   # a part holds 2**6 turn numbers
START, END = "<|im_start|>", "<|im_end|>"
# Control strings that a text may not hold bare.
CONTROL = r"<\|(?:im_start|im_end|endoftext|system|user|assistant)\|>|</?s>|\[/?INST\]|<</?SYS>>"
TRAINED_ROLE = "assistant"


def escape(text) -> F.Column:
    return F.regexp_replace(text, r"(\\*(?:" + CONTROL + "))", r"\\$1")


def unescape(text) -> F.Column:
    return F.regexp_replace(text, r"\\(\\*(?:" + CONTROL + "))", "$1")


def _escape_role(role) -> F.Column:
    r"""Roles stand on one line: a backslash is written as ``\b`` and a newline as ``\n``; no character is special beside."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role) -> F.Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _part() -> F.Column:
    return F.shiftright(F.col("turn"), PART_BITS)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, part, turn, message, role, text)`` of an event log.

    ``events`` has ``conv_id, seq, kind, turn, message, role, text``; ``message`` tells apart messages
    that share a turn number (0 where a turn has one message).
    """
    # A regeneration at (seq, turn) discards earlier events of that turn and of all later turns: for an event
    # it is enough to know the last regeneration of a turn not above its own.  Inside a part that is a running
    # maximum; of the parts before it, one row per part is summed up.
    e = events.withColumn("part", _part()).withColumn("cut", F.when(F.col("kind") == "regenerate", F.col("seq")))
    e = e.repartition("conv_id", "part")
    so_far = Window.partitionBy("conv_id", "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("cut", F.max("cut").over(so_far))
    regenerated = events.filter(F.col("kind") == "regenerate").select("conv_id", _part().alias("part"), "seq")
    parts = (events.select("conv_id", _part().alias("part"), F.lit(None).cast(events.schema["seq"].dataType).alias("seq"))
             .unionByName(regenerated).groupBy("conv_id", "part").agg(F.max("seq").alias("last")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("p_conv"), F.col("part").alias("p_part"), F.max("last").over(before).alias("p_cut"))
    parts = parts.filter("p_cut IS NOT NULL")
    e = e.filter(F.col("kind") != "regenerate")
    live = e.join(parts, e["conv_id"].eqNullSafe(parts["p_conv"]) & (e["part"] == parts["p_part"]), "left")
    return _fold(live.filter(F.coalesce(F.col("seq") > F.greatest("cut", "p_cut"), F.lit(True))))


def _fold(live: DataFrame) -> DataFrame:
    """Fold the deltas and edits of every message in the order of ``seq``."""
    one = (live.repartition("conv_id", "part")
           .groupBy("conv_id", "part", "turn", "message")
           .agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))))
                .alias("log"),
                F.max(F.when(F.col("kind") == "edit", F.col("seq"))).alias("edited")))
    current = F.filter("log", lambda x: F.col("edited").isNull() | (x["seq"] >= F.col("edited")))
    return one.select("conv_id", "part", "turn", "message", F.coalesce(F.element_at("log", -1)["role"], F.lit("")).alias("role"),
                      F.array_join(F.transform(current, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, part, formatted, loss_mask)`` per part: the rendered string and its trained spans."""
    m = messages.select("conv_id", "part", "turn", "role", (F.col("role") == TRAINED_ROLE).alias("trained"), "text",
                        F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("lead"),
                        escape(F.col("text")).alias("body"))
    tail = "\n" + END + "\n"
    piece = F.struct("turn", "role", "text", "lead", "body", "trained")
    g = m.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    spans = F.aggregate(
        "p", F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["lead"]) + F.length(x["body"]) + len(tail)).alias("at"),
            F.when(x["trained"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(x["lead"])).alias("start"),
                (a["at"] + F.length(x["lead"]) + F.length(x["body"])).alias("end")))))
            .otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    text = F.array_join(F.transform("p", lambda x: F.concat(x["lead"], x["body"], F.lit(tail))), "")
    return g.select("conv_id", "part", text.alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of the turns and of the text under the loss mask, read from the output."""
    pieces = F.filter(F.split("formatted", r"\n<\|im_end\|>\n", -1), lambda x: x != "")   # the last one is empty
    parsed = F.transform(pieces, lambda x: F.struct(
        _unescape_role(F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(x, F.locate("\n", x) + 1)).alias("text")))
    masked = F.transform("loss_mask", lambda s: unescape(
        F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    p = (formatted.withColumn("turns", parsed)
         .select("conv_id", "part", F.size("turns").cast("long").alias("n"),
                 F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
                 .alias("turn_text"),
                 F.array_join(masked, "").alias("loss_text"), F.length("formatted").cast("long").alias("n_chars")))
    # A digest of one whole conversation needs its text in one place: parts arrive here already joined.
    g = p.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "turn_text", "loss_text"))).alias("parts"),
        F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"))
    turns = F.array_join(F.transform("parts", lambda x: x["turn_text"]), "")
    loss = F.array_join(F.transform("parts", lambda x: x["loss_text"]), "")
    return g.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                    "formatted_chars")


def events_of_rows(rows: DataFrame) -> DataFrame:
    """The log of a session that ends in the rows ``(conv_id, turn, role, text)``, with one ``seq`` per conversation.

    Every assistant turn is drafted first (its text backwards), a follow-up already comes in on the turn behind it,
    and then the turn is regenerated, which discards both.  Every message then arrives with its first half
    backwards, an edit puts that half right, and the rest is appended.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = rows.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
                       F.coalesce("role", F.lit("")).alias("role"), body.alias("text"),
                       F.monotonically_increasing_id().alias("message"))   # tells rows of one turn apart
    base = base.withColumn("first", F.expr("left(text, length(text) div 2)"))

    def event(k: int, kind: str, piece, turns_on: int = 0) -> F.Column:
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(turns_on).alias("on"), piece.alias("piece"))

    drafted = F.array(event(0, "delta", F.reverse("text")), event(1, "delta", F.lit("And then?"), 1), event(2, "regenerate", F.lit("")))
    arrived = F.array(event(3, "delta", F.reverse("first")), event(4, "edit", F.col("first")),
                      event(5, "delta", F.expr("substr(text, length(text) div 2 + 1)")))
    log = F.when(F.col("role") == TRAINED_ROLE, F.concat(drafted, arrived)).otherwise(arrived)
    # Eight numbers per turn; a decimal, as turns may be any long.
    seq = F.col("turn").cast("decimal(20,0)") * 8 + F.col("e.k")
    return (base.withColumn("e", F.explode(log))
            .select("conv_id", F.when(F.col("e.on") == 1, F.col("turn") + 1).otherwise(F.col("turn")).alias("turn"), "message",
                    F.when(F.col("e.on") == 1, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    seq.alias("seq"), F.col("e.kind").alias("kind"), F.col("e.piece").alias("text")))


def chat_digest(rows: DataFrame) -> DataFrame:
    """Log, fold, render and read back: one row per conversation."""
    return read_back(render(fold_events(events_of_rows(rows))))


PROBE = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') "
                      "AS t(conv_id, turn, role, text)")
    return chat_digest(rows.unionByName(probe))


QUERIES = {"op10_chat_formatting": op10_chat_formatting}
ORACLE_SQL = {"op10_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, 25 + length(role) + length(text) + len(regexp_extract_all(text,
    '<\|(?:im_start|im_end|endoftext|system|user|assistant)\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""}
