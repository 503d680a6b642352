"""Mixing sources to target weights: hierarchical budgets over a tree of columns.

Tokens (words) available are summed per leaf of the tree domain > language > source. The
budget flows down: children share their parent's tokens by weight, a child that cannot
use its share is filled up and the rest goes to its siblings; only what all of them
cannot use goes to the parent's own siblings. Tokens are whole numbers, so the leaves'
budgets add up to the budget. A leaf that gets more than it has repeats whole epochs; of
its last epoch it takes a prefix in an order of its own, given by seed and epoch. That
prefix is one cut value per leaf, found from counts per range of the order: texts are
neither shuffled nor sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from campanula.llm.common import cut, text_or_empty

SEED = 17
MAX_EPOCHS = 4
LEVELS = ("domain", "lang", "source")
#: Weights by level and value; values that are not named weigh 1.
WEIGHTS = {
    "domain": {"web": 5, "books": 3, "reference": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
    "source": {},
}
#: Leaves up to this number are broadcast (under 200 bytes each); more are joined by shuffle.
BROADCAST_LEAVES = 50_000
#: Leading hexadecimal digits of the order that form a range.
RANGE_DIGITS = 4


def domain_of(source: Column) -> Column:
    """Domain of a source by its number: 0-6 web, 7-13 books, others (and no number) reference."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    n = F.when(number != "", number.cast("int"))
    return F.when(n <= 6, "web").when(n <= 13, "books").otherwise("reference")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("decimal(10,0)")


def _share_out(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Turn each row's ``budget`` (its parent's) into its own, by ``weight`` and ``cap``."""
    kin = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    scarcity = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(float("inf")))
    before = kin.orderBy(scarcity, child).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(kin)
    zero = F.lit(0)
    d = lambda c: c.cast("decimal(20,0)")
    nodes = nodes.withColumns({
        "_left": d(F.col("budget") - F.coalesce(F.sum("cap").over(before), zero)),
        "_weights": d(total("weight") - F.coalesce(F.sum("weight").over(before), zero)),
    })
    nodes = nodes.withColumn("_full", d(F.col("cap")) * F.col("_weights") <= d(F.col("weight")) * F.col("_left"))
    nodes = nodes.withColumns({
        "_left": d(F.col("budget") - total(F.when(F.col("_full"), F.col("cap")).otherwise(zero))),
        "_weights": d(total(F.when(~F.col("_full"), F.col("weight")).otherwise(zero))),
    })
    part = F.expr("cast((_left * cast(weight as decimal(10,0))) div _weights as bigint)")
    nodes = nodes.withColumn("_got", F.when(F.col("_full"), F.col("cap")).when(F.col("_weights") > 0, part).otherwise(zero))
    nodes = nodes.withColumns({
        "_rest": F.col("budget") - total("_got"),
        "_turn": F.row_number().over(kin.orderBy("_full", F.col("weight") == 0, child)),
    })
    more = ~F.col("_full") & (F.col("weight") > 0) & (F.col("_turn") <= F.col("_rest"))
    return nodes.withColumn("budget", F.col("_got") + more.cast("long")).drop("_left", "_weights", "_full", "_got", "_rest", "_turn")


def budgets(leaves: DataFrame, levels: tuple[str, ...], weights: dict, budget: int | None, max_epochs: int) -> DataFrame:
    """Leaves (levels..., tokens) with ``budget``; without a number the budget is all tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    wanted = F.sum("tokens").over(Window.partitionBy(F.lit(0))) if budget is None else F.lit(budget)
    out = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        if out is None:
            all_caps = F.sum("cap").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("budget", F.least(wanted.cast("long"), all_caps))
        else:
            same = [nodes[c].eqNullSafe(out[c]) for c in path[:-1]]
            on = same[0]
            for c in same[1:]:
                on = on & c
            nodes = nodes.join(out.select(*path[:-1], "budget"), on).select(*(nodes[c] for c in (*path, "cap", "tokens")), out["budget"])
        out = _share_out(nodes.withColumn("weight", _weight(level, weights)), path[:-1], level).drop("weight")
    return out


def _same(left: DataFrame, right: DataFrame, levels: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for c in levels:
        on = on & left[c].eqNullSafe(right[c])
    return on


def _bounded(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def _order(seed: int) -> Column:
    """Place of a document in its leaf's epoch, equal only for repeated rows."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_digest")))


def cuts(narrow: DataFrame, levels: tuple[str, ...], weights: dict, budget: int | None, max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: budget, whole ``epochs``, and where its last epoch is cut.

    ``narrow`` has the levels, _id, _digest and tokens of every document. Documents
    before ``cut_at`` are taken whole, those at it with ``cut_tokens`` tokens each.
    """
    leaves = cut(narrow.groupBy(*levels).agg(F.sum("tokens").alias("tokens")))
    shared = budgets(leaves, levels, weights, budget, max_epochs)
    shared = shared.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
    shared = cut(shared.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("cap"))
    few = _bounded(shared.filter("rest > 0").select(*(F.col(c).alias(f"_{c}") for c in levels), "epochs", "rest"))
    on = F.lit(True)
    for c in levels:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = narrow.join(few, on).select(*levels, "rest", _order(seed).alias("at"), "tokens")
    placed = cut(placed.withColumn("range", F.substring("at", 1, RANGE_DIGITS)))
    ranges = placed.groupBy(*levels, "rest", "range").agg(F.sum("tokens").alias("n"))
    ordered = Window.partitionBy(*levels).orderBy("range")
    ranges = ranges.withColumn("to", F.sum("n").over(ordered)).filter("to - n < rest and to >= rest and n > 0")
    ranges = cut(ranges.select(*levels, F.col("range").alias("_range"), (F.col("rest") - F.col("to") + F.col("n")).alias("left")))
    inside = placed.join(_bounded(ranges), _same(placed, ranges, levels) & (placed["range"] == ranges["_range"]))
    inside = inside.select(*(placed[c] for c in levels), "at", "tokens", "left")
    inside = inside.groupBy(*levels, "at", "left").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows"))
    inside = inside.withColumn("to", F.sum("n").over(Window.partitionBy(*levels).orderBy("at")))
    ends = inside.filter("to - n < left and to >= left and n > 0")
    ends = ends.select(*levels, F.col("at").alias("cut_at"), F.expr("(left - to + n) div rows").alias("cut_tokens"))
    out = shared.join(ends, _same(shared, ends, levels), "left")
    return cut(out.select(*(shared[c] for c in levels), "tokens", "budget", "epochs", "cut_at", F.coalesce("cut_tokens", F.lit(0)).alias("cut_tokens")))


def _narrow(docs: DataFrame, levels: dict[str, Column], id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        *(c.alias(k) for k, c in levels.items()),
        F.col(id_col).alias("_id"),
        F.md5(text).alias("_digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
    )


def level_columns() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def mix(docs: DataFrame, levels: dict[str, Column] | None = None, weights: dict = WEIGHTS, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chosen documents with the columns of ``docs``, one row for each epoch that takes them.

    The document at a leaf's cut keeps only its first words; ``n_chars`` follows. Null
    texts have no tokens. Null levels are values like others.
    """
    levels = levels or level_columns()
    names = tuple(f"_level_{k}" for k in levels)
    weights = {f"_level_{k}": v for k, v in weights.items()}
    narrow = _narrow(docs, {f"_level_{k}": c for k, c in levels.items()}, id_col, text_col)
    both = docs.select(F.struct(*docs.columns).alias("_doc"), *(c.alias(f"_level_{k}") for k, c in levels.items()), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    both = both.withColumns({"_digest": F.md5("_text"), "n_tokens": F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})
    found = cuts(narrow.withColumnRenamed("n_tokens", "tokens"), names, weights, budget, max_epochs, seed)
    chosen = _apply(both, found, names, seed)
    whole = F.col("take_tokens") >= F.col("n_tokens")
    copies = F.flatten(F.array(
        F.when(F.col("epochs") > 0, F.array_repeat(F.lit(True), F.col("epochs").cast("int"))).otherwise(F.array().cast("array<boolean>")),
        F.when((F.col("take_tokens") > 0) | (whole & F.col("_in_prefix")), F.array(whole)).otherwise(F.array().cast("array<boolean>")),
    ))
    rows = chosen.withColumn("_whole", F.explode(copies))
    start = F.regexp_substr("_text", F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("take_tokens").cast("string"), F.lit("}+")))
    text = F.when(F.col("_whole"), F.col("_doc")[text_col]).otherwise(start)
    out = {c: F.col("_doc")[c] for c in docs.columns} | {text_col: text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_whole"), F.col("_doc")["n_chars"]).otherwise(F.length(start).cast(docs.schema["n_chars"].dataType))
    return rows.select(*(c.alias(k) for k, c in out.items()))


def _apply(rows: DataFrame, found: DataFrame, levels: tuple[str, ...], seed: int) -> DataFrame:
    leaf = _bounded(found.select(*(F.col(c).alias(f"_leaf{c}") for c in levels), "epochs", "cut_at", "cut_tokens"))
    on = F.lit(True)
    for c in levels:
        on = on & F.col(c).eqNullSafe(F.col(f"_leaf{c}"))
    out = rows.join(leaf, on).withColumn("_at", _order(seed))
    take = F.when(F.col("_at") < F.col("cut_at"), F.col("n_tokens")).when(F.col("_at") == F.col("cut_at"), F.col("cut_tokens")).otherwise(0)
    inside = F.coalesce(F.col("_at") < F.col("cut_at"), F.lit(False))
    return out.withColumns({"take_tokens": take, "_in_prefix": inside})


def op3(docs: DataFrame) -> DataFrame:
    narrow = cut(_narrow(docs, level_columns(), "doc_id", "text"))
    found = cuts(narrow.withColumnRenamed("n_tokens", "tokens"), LEVELS, WEIGHTS, None, MAX_EPOCHS, SEED)
    out = _apply(narrow, found, LEVELS, SEED).filter("epochs > 0 or take_tokens > 0 or _in_prefix")
    return out.select(F.col("_id").alias("doc_id"), *LEVELS, "n_tokens", "epochs", "take_tokens")
