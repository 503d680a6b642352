"""Chat formatting: collapse logged snapshots of growing conversations, then render.

A conversation that is a prefix of a longer one is a snapshot of it. A turn's prefix hash
is the running XOR of hashes of (position, role, text), so it needs one pass over the
turns in order. Conversations whose whole hash is a proper prefix hash of another are
anti-joined away; of equal conversations the one with the smallest id stays. Both join
sides hold one row per hash, so common first turns cost nothing more.

Only digests of turns are numbered and hashed. Texts move once, to be rendered; before
that they are read only where one turn number has several texts, whose order they decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campanula.llm.common import stored

#: Turn numbers that are scanned together, and turns that are rendered into one row.
SPAN = 1024
#: Span of the rows without a turn number, behind all others.
LAST = 1 << 62
MARKS = ("<|im_start|>", "<|im_end|>")


def _turns(turns: DataFrame) -> DataFrame:
    """Rows (key, conv_id, late, turn, role, text); a row without conv_id is a conversation of its own, equal ones are one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    own = F.concat_ws(":", F.lit("own"), F.coalesce(F.col("turn").cast("string"), F.lit("")), F.sha2(F.concat_ws("\x1f", role, text), 256))
    key = F.coalesce(F.concat(F.lit("id:"), F.col("conv_id").cast("string")), own)
    turn = F.col("turn").cast("long")
    rows = turns.select(key.alias("key"), "conv_id", turn.isNull().alias("late"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"), text.alias("text"))
    return rows.filter("conv_id is not null").union(rows.filter("conv_id is null").distinct())


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with span, position from 1, and the conversation's n_turns, in order of late, turn and ``order``."""
    rows = rows.withColumn("span", F.when(F.col("late"), LAST).otherwise(F.floor(F.col("turn") / SPAN)))
    spans = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("key", "span").agg(F.count("*").alias("n")).select(
        "key", "span", F.coalesce(F.sum("n").over(spans), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("key")).alias("n_turns")
    )
    inside = Window.partitionBy("key", "span").orderBy("turn", *order)
    counted = rows.withColumn("k", F.row_number().over(inside)).join(totals, ["key", "span"])
    return counted.withColumn("position", F.col("k") + F.col("before")).drop("k", "before")


def _ordered_digests(rows: DataFrame) -> DataFrame:
    """Rows (key, conv_id, late, turn, a, b, tie): two hashes for each turn, and its rank by role and text among those of its number."""
    place, digest = ["key", "late", "turn"], ["a", "b"]
    hashed = rows.withColumns({c: F.xxhash64(F.lit(salt), "role", "text") for c, salt in (("a", 11), ("b", 29))})
    slim = hashed.select(*place, "conv_id", *digest)
    several = slim.groupBy(*place).agg(F.min(F.struct(*digest)).alias("x"), F.max(F.struct(*digest)).alias("y")).filter("x != y")
    tied = hashed.join(stored(several.select(*place)), place, "left_semi").select(*place, *digest, "role", "text")
    tied = tied.groupBy(*place, *digest).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("role", "text"))
    ranks = stored(tied.select(*place, *digest, rank.alias("tie")))
    return slim.join(ranks, [*place, *digest], "left").withColumn("tie", F.coalesce("tie", F.lit(0)))


def _hashes(digests: DataFrame) -> DataFrame:
    """(key, conv_id, position, n_turns, h1, h2): the 128-bit hash of the conversation up to each turn."""
    names = {"h1": F.xxhash64(F.lit(5), "position", "a", "b"), "h2": F.xxhash64(F.lit(7), "position", "b", "a")}
    rows = _numbered(digests, "tie").select("key", "conv_id", "span", "position", "n_turns", *(c.alias(h) for h, c in names.items()))
    upto = Window.partitionBy("key", "span").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    spans = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("key", "span").agg(*(F.bit_xor(h).alias(h) for h in names))
    before = totals.select("key", "span", *(F.coalesce(F.bit_xor(h).over(spans), F.lit(0)).alias(f"_{h}") for h in names))
    running = rows.withColumns({h: F.bit_xor(h).over(upto) for h in names}).join(before, ["key", "span"])
    return running.select("key", "conv_id", "position", "n_turns", *(F.col(h).bitwiseXOR(F.col(f"_{h}")).alias(h) for h in names))


def maximal(turns: DataFrame) -> DataFrame:
    """(key, n_turns, n_copies) of the conversations that stay; keys are those of ``_turns``."""
    hashes = stored(_hashes(_ordered_digests(_turns(turns))))
    same = ["h1", "h2", "n_turns"]
    first = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "key")).alias("c")
    whole = hashes.filter("position = n_turns").groupBy(*same).agg(first, F.count("*").alias("n_copies"))
    proper = hashes.filter("position < n_turns").select("h1", "h2", F.col("position").alias("n_turns")).distinct()
    return whole.join(proper, same, "left_anti").select("c.key", "n_turns", "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, part, n_turns, n_copies, rendered) of the conversations that stay.

    Turns stand in order of turn (null last), role, text; repeated rows are turns of
    their own. Null roles and texts count as empty. A conversation of over ``SPAN``
    turns is rendered in parts, whose texts in order make the whole. Marks inside a
    text are broken by a blank after their first character, so none opens a turn. Rows
    without conv_id are conversations of one turn; equal ones count once.
    """
    kept = stored(maximal(turns))
    rows = _turns(turns)
    order = ("late", "turn", "role", "text")
    short = rows.join(kept.filter(F.col("n_turns") <= SPAN), "key").withColumn("part", F.lit(0))
    long = _numbered(rows.join(kept.filter(F.col("n_turns") > SPAN).select("key", "n_copies"), "key"), "role", "text")
    long = long.withColumn("part", F.floor((F.col("position") - 1) / SPAN).cast("int"))
    by = ("key", "conv_id", "part", "n_turns", "n_copies")
    turns_of = F.array_sort(F.collect_list(F.struct(*order))).alias("turns")
    chats = short.groupBy(*by).agg(turns_of).union(long.groupBy(*by).agg(turns_of))
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    line = lambda x: F.concat(F.lit(MARKS[0]), safe(x["role"]), F.lit("\n"), safe(x["text"]), F.lit(MARKS[1] + "\n"))
    return chats.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("turns", line), "").alias("rendered"))


def op1(turns: DataFrame) -> DataFrame:
    return format_chats(turns)


SQL = """
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS position
  FROM conversations
), prefixes AS (
  SELECT conv_id, position,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY position) AS upto,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM numbered
), whole AS (
  SELECT upto, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE position = n_turns GROUP BY upto, n_turns
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (
    SELECT 1 FROM prefixes p WHERE p.position < p.n_turns AND p.position = w.n_turns AND p.upto = w.upto)
)
SELECT conv_id, CAST((position - 1) // 1024 AS INTEGER) AS part, n_turns, n_copies,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY position) AS rendered
FROM kept JOIN numbered USING (conv_id)
GROUP BY conv_id, CAST((position - 1) // 1024 AS INTEGER), n_turns, n_copies
"""
