"""Chat formatting with a grammar round trip, in DataFrame functions alone.

Grammar: chat := turn*; turn := "###" ["!"] " " role ": " body "</turn>\\n". "###" and "</turn>" are control strings, and a
body holds neither. A turn is first rendered with its text as it is and parsed again; where the parser doesn't return the
role and text that went in, the turn is rendered with "!" and with its conflicting content escaped, which the grammar
always returns unchanged: "\\" becomes "\\b", "###" "\\h", "</turn>" "\\t". Roles are always escaped (":" becomes "\\c").
The formatted conversation is parsed as a whole, and a difference from its source is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import table

OPEN, CLOSE, LOSS_ROLE = "###", "</turn>", "assistant"
#: What is written for a control string.
TEXT_ESCAPES = [("\\", "\\b"), (OPEN, "\\h"), (CLOSE, "\\t")]
ROLE_ESCAPES = [("\\", "\\b"), (":", "\\c"), (OPEN, "\\h"), (CLOSE, "\\t")]
_HEADER = r"^###(!?) ([^:]*): "


def _escape(x: Column, pairs) -> Column:
    for plain, code in pairs:
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def _unescape(x: Column, pairs) -> Column:
    for plain, code in reversed(pairs):  # the backslash comes back last: nothing before it makes one
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    mark = OPEN + "!" if escaped else OPEN
    return F.concat(F.lit(mark + " "), _escape(role, ROLE_ESCAPES), F.lit(": "), _escape(text, TEXT_ESCAPES) if escaped else text, F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted chat; a body that holds a control string gives null."""

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, _HEADER, 0)
        body = F.substr(piece, F.length(head) + 1)
        text = F.when(F.regexp_extract(piece, _HEADER, 1) == "!", _unescape(body, TEXT_ESCAPES)).otherwise(body)
        good = (F.length(head) > 0) & ~F.contains(body, F.lit(OPEN))
        return F.struct(F.when(good, _unescape(F.regexp_extract(piece, _HEADER, 2), ROLE_ESCAPES)).alias("role"), F.when(good, text).alias("text"))

    pieces = F.split(formatted, "</turn>\n?", -1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_spans array<struct<start, length, escaped>>) by conversation.

    turns(conv_id, turn, role, text): rows by turn, nulls first; ties by role, then text; repeated rows are turns of their
    own. A null role or text is empty, a null conv_id a conversation like others. loss_spans are the bodies of assistant
    turns in code points of formatted, and whether they are written escaped; turns are those read back from formatted. An
    empty table gives no rows. Other columns, whatever their names, are not read. Texts of any length stay whole; a
    conversation is one value in the end, so its turns meet in one row, of 2 GB at most as any value of Spark's.
    """
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = render_turn(F.col("role"), F.col("text"), False)
    same = F.coalesce(parse(plain) == F.array(F.struct("role", "text")), F.lit(False))
    t = t.withColumn("same", same).withColumn("out", F.when(F.col("same"), plain).otherwise(render_turn(F.col("role"), F.col("text"), True)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("n", F.row_number().over(order)).withColumn("upto", F.sum(F.length("out").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.length(F.regexp_extract("out", _HEADER, 0))
    span = F.struct((F.col("upto") - F.length("out") + head).alias("start"), (F.length("out") - head - len(CLOSE) - 1).cast("long").alias("length"), (~F.col("same")).alias("escaped"))
    rows = F.array_sort(F.collect_list(F.struct("n", "out", "role", "text", span.alias("span"))))
    c = t.groupBy("conv_id").agg(rows.alias("rows"))
    c = c.select("conv_id", "rows", F.array_join(F.transform("rows", lambda r: r["out"]), "").alias("formatted"))
    c = c.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    spans = F.transform(F.filter("rows", lambda r: r["role"] == LOSS_ROLE), lambda r: r["span"])
    checked = F.when(F.coalesce(F.col("turns") == source, F.lit(False)), F.col("turns")).otherwise(F.raise_error(F.lit("a formatted chat doesn't parse to its source")))
    return c.select("conv_id", "formatted", checked.alias("turns"), spans.alias("loss_spans"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under a loss mask: what the spans cut out of a formatted chat, unescaped, in order, nothing between."""

    def one(s: Column) -> Column:
        body = F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        return F.when(s["escaped"], _unescape(body, TEXT_ESCAPES)).otherwise(body)

    return F.array_join(F.transform(spans, one), "")


#: A conversation whose texts hold every control string.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 2 over the whole conversations table and the probe."""
    probe = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in PROBE])))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    c = format_chats(turns)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    c = c.withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    return c.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) AS p(conv_id, turn, role, text)),
e AS (SELECT *, contains(text, '###') OR contains(text, '</turn>') AS clash, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS code, replace(replace(replace(replace(role, '\', '\b'), ':', '\c'), '###', '\h'), '</turn>', '\t') AS name FROM c),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(length(name) + 14 + CASE WHEN clash THEN 1 + length(code) ELSE length(text) END) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
