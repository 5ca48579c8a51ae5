"""Chat formatting: conversations as budgeted windows with a loss mask.

Prefix sums of turn tokens choose the windows: body tokens are dealt into
cells of half the body budget, and a window takes the turns that start in one
cell, so that it stays within the budget; a turn of more than half the budget
stands alone. Windows are turn-aligned and each turn is fresh in exactly one.
Later windows repeat the system turn and the last turns before them up to the
history budget. The loss mask covers the texts of fresh assistant turns alone.

Everything is window functions, grouping and string expressions. Only turns of
one conversation meet in a task, and only the digests of the read-back put a
conversation's text in one row.

Nulls: a null role or text is the empty string; null conversation ids form one
conversation; a null turn number comes first. Repeated rows are turns of their
own; ties on the turn number go by role, then text. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that control this or another common template, and what stands for them; the first also makes this reversible.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"))
UNESCAPES = (("&lt;", "<"), ("&#91;", "["), ("&amp;", "&"))
#: Tokens of a window, of them for repeated history, the least that a window's body gets, and of a turn's marks.
WINDOW_TOKENS, HISTORY_TOKENS, LEAST_BODY, TURN_MARKS = 1024, 128, 128, 4


def escape(text: Column) -> Column:
    for old, new in ESCAPES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column) -> Column:
    for old, new in UNESCAPES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def turn_tokens(text: Column) -> Column:
    """An estimate that needs no vocabulary: a token for each four code points, and the turn's marks."""
    return (F.ceil(F.length(text) / 4) + TURN_MARKS).cast("long")


def windows(df: DataFrame, window_tokens: int = WINDOW_TOKENS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """(conv_id, window, formatted, n_context, loss): the windows of all conversations.

    ``df`` has conv_id, turn, role, text. n_context: how many turns at the
    front are repeated. loss: array of (start, length) in code points.
    """
    turns = df.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text")).withColumn("tokens", turn_tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = turns.withColumns({"rank": F.row_number().over(order), "until": F.sum("tokens").over(so_far)})
    system = F.when((F.col("rank") == 1) & (F.col("role") == "system"), F.col("tokens"))
    half = F.greatest(F.lit(LEAST_BODY), F.lit(window_tokens - history_tokens) - F.coalesce(F.col("system"), F.lit(0))) / 2
    placed = (
        counted.withColumn("system", F.max(system).over(Window.partitionBy("conv_id")))
        .withColumns({"start": F.col("until") - F.col("tokens"), "half": F.floor(half)})
        .withColumns({"cell": F.floor(F.col("start") / F.col("half")), "large": F.col("tokens") > F.col("half")})
    )
    apart = (F.lag("cell").over(order) != F.col("cell")) | F.col("large") | F.lag("large").over(order)
    opened = placed.withColumn("opens", F.coalesce(apart, F.lit(True))).withColumn("window", F.sum(F.col("opens").cast("int")).over(so_far))
    # A turn is history of each window that opens at most so many tokens after the turn's own start.
    ahead = Window.partitionBy("conv_id").orderBy("start").rangeBetween(1, history_tokens)
    later = F.collect_list(F.when(F.col("opens"), F.col("window"))).over(ahead)
    last = F.max("window").over(Window.partitionBy("conv_id"))
    is_system = (F.col("rank") == 1) & (F.col("role") == "system")
    repeated = opened.withColumns({"later": later, "last": last}).withColumn("in_windows", F.when(is_system, F.sequence(F.col("window"), F.col("last"))).otherwise(F.concat(F.array("window"), "later")))
    header = F.concat(F.lit(BEGIN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    spread = repeated.select("conv_id", "rank", "role", "window", header.alias("header"), escape(F.col("text")).alias("body"), F.explode("in_windows").alias("shown_in"))
    within = Window.partitionBy("conv_id", "shown_in").orderBy("rank")
    pieces = spread.select("conv_id", "shown_in", "rank", (F.col("window") == F.col("shown_in")).alias("fresh"), "role", F.length("header").alias("head_chars"), F.length("body").alias("body_chars"), F.concat("header", "body", F.lit(END)).alias("piece"))
    at = F.sum(F.length("piece")).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")
    masked = pieces.withColumn("loss", F.when(F.col("fresh") & (F.col("role") == "assistant"), F.struct((at + F.col("head_chars")).cast("int").alias("start"), F.col("body_chars").alias("length"))))
    return (
        masked.groupBy("conv_id", "shown_in")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "piece"))).alias("all"), F.sum((~F.col("fresh")).cast("int")).alias("n_context"), F.sort_array(F.collect_list("loss")).alias("loss"))
        .select("conv_id", F.col("shown_in").alias("window"), F.array_join(F.col("all")["piece"], "").alias("formatted"), "n_context", "loss")
    )


def read_windows(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, roles, texts, loss_text, formatted_chars): the fresh turns of each window and the text under its mask, read from the formatted string."""
    pieces = F.split("formatted", END.replace("|", r"\|"), -1)
    fresh = formatted.withColumn("pieces", pieces).withColumn("fresh", F.slice("pieces", F.col("n_context") + 1, F.greatest(F.size("pieces") - 1 - F.col("n_context"), F.lit(0))))
    role = lambda p: F.replace(unescape(F.substring_index(F.replace(p, F.lit(BEGIN), F.lit("")), "\n", 1)), F.lit("&#10;"), F.lit("\n"))
    text = lambda p: unescape(F.substr(p, F.instr(p, "\n") + 1))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return fresh.select("conv_id", "window", F.transform("fresh", role).alias("roles"), F.transform("fresh", text).alias("texts"), loss.alias("loss_text"), F.length("formatted").alias("formatted_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: what the windows of all conversations, and of one made to confuse a template, give back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    read = read_windows(windows(given.unionByName(odd)))
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    parts = read.select("conv_id", "window", F.size("roles").alias("n"), said.alias("said"), "loss_text", "formatted_chars")
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_join(F.sort_array(F.collect_list(F.struct("window", "said")))["said"], "").alias("said"),
        F.array_join(F.sort_array(F.collect_list(F.struct("window", "loss_text")))["loss_text"], "").alias("loss_text"),
        F.sum("formatted_chars").cast("long").alias("formatted_chars"),
    )
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, ceil(length(text) / 4)::BIGINT + 4 AS tokens,
        length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]'))
        + length(replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]'), chr(10), '&#10;')) + 24 AS chars,
        row_number() OVER w AS rank
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), started AS (
    SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY rank) - tokens AS start,
        floor(greatest(128, 1024 - 128 - coalesce(max(CASE WHEN rank = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0)) / 2) AS half
    FROM sized
), opened AS (
    SELECT *, coalesce(lag(floor(start / half)) OVER w <> floor(start / half) OR tokens > half OR lag(tokens > half) OVER w, true) AS opens
    FROM started WINDOW w AS (PARTITION BY conv_id ORDER BY rank)
), windowed AS (
    SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY rank) AS part FROM opened
), repeats AS (
    SELECT t.conv_id, sum(t.chars) AS chars
    FROM windowed t JOIN windowed o ON o.conv_id IS NOT DISTINCT FROM t.conv_id AND o.opens AND o.rank > t.rank
        AND ((t.rank = 1 AND t.role = 'system' AND o.part > t.part) OR (NOT (t.rank = 1 AND t.role = 'system') AND o.start - t.start <= 128))
    GROUP BY t.conv_id
), whole AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank) AS said,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rank), '') AS loss_text, sum(chars) AS chars
    FROM windowed GROUP BY conv_id
)
SELECT w.conv_id, n_turns, sha256(said) AS turns_sha256, length(loss_text)::BIGINT AS loss_chars, sha256(loss_text) AS loss_sha256,
    (w.chars + coalesce(r.chars, 0))::BIGINT AS formatted_chars
FROM whole w LEFT JOIN repeats r ON r.conv_id IS NOT DISTINCT FROM w.conv_id
"""
