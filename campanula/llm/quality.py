"""Quality rules by weak supervision: rules vote or abstain, EM weighs them.

Everything is a column expression or an aggregation. A rule votes good (1), bad (-1)
or abstains (0). The corpus is reduced to counts of vote patterns, at most
3 ** rules rows whatever its size; EM runs on that table. A document's posterior
then follows from its own votes and the estimated accuracies, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanula.llm.common import cut, let, text_or_empty, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ROUNDS = 12
#: Accuracies stay inside these bounds. A rule sees one kind of junk, so it may miss most
#: bad documents; on good documents it has to be right, so that its votes keep their meaning.
LEAST_ON_GOOD, LEAST_ON_BAD, MOST = 0.97, 0.12, 0.999

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and, by rule, how often its vote is right.

    ``on_good``: share of a rule's votes on good documents that say good.
    ``on_bad``: share of its votes on bad documents that say bad.
    """

    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]


def _covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice in ``hashes``."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(rows: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(rows, k)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(rows, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    return F.aggregate(
        F.array_sort(let(placed, repeated)),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("covered")),
        lambda acc, p: F.struct(p.alias("last"), (acc["covered"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("covered")),
        lambda acc: acc["covered"],
    )


def _repeat_words(ws: Column) -> Column:
    def of_windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    hashes = let(F.transform(ws, lambda w: F.xxhash64(w)), of_windows)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered_words(h)).otherwise(0))
    return F.when(F.size(ws) >= WINDOW, found).otherwise(0)


def _measures(text: Column) -> Column:
    def without(pattern: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return F.struct(
        let(words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        without(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        without(r"\p{Lu}").cast("long").alias("n_upper"),
        without(r"[!?]").cast("long").alias("n_shouts"),
        without(r"[^\p{L}\x20\x09-\x0D]").cast("long").alias("n_not_letters"),
        F.regexp_count(text, F.lit(r"(?<!\S)[^\p{L}\s]+(?!\S)")).cast("long").alias("n_bare_words"),
    )


def features(docs: DataFrame, text_col: str = "text", out_col: str = "features") -> DataFrame:
    """Add struct ``out_col`` with the measures of each whole text (null counts as empty).

    Every input row and column stays; a column already called ``out_col`` is replaced.
    """
    m = let(_measures(text_or_empty(text_col)), lambda m: F.struct(
        *(m["w"][n].alias(n) for n in ("n_words", "word_chars", "n_distinct", "n_repeat_words")),
        *(m["l"][n].alias(n) for n in ("n_lines", "n_dup_lines")),
        *(m[n].alias(n) for n in ("n_symbols", "n_upper", "n_shouts", "n_not_letters", "n_bare_words")),
    ))
    return docs.withColumn(out_col, m)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(f: Column) -> dict[str, Column]:
    """The rules over a features struct; an empty text makes all of them abstain but ``long_enough``."""
    n = F.nullif(f["n_words"], F.lit(0))
    chars = F.nullif(f["word_chars"], F.lit(0))
    lines = F.nullif(f["n_lines"], F.lit(0))
    length, dup = f["word_chars"] / n, f["n_dup_lines"] / lines
    symbols, upper, shouts = f["n_symbols"] / n, f["n_upper"] / chars, f["n_shouts"] / n
    letters, bare = 1 - f["n_not_letters"] / chars, f["n_bare_words"] / n
    repeats, distinct = f["n_repeat_words"] / n, f["n_distinct"] / n
    return {
        "long_enough": _vote(f["n_words"] >= 50, f["n_words"] < MIN_WORDS),
        "few_symbols": _vote(symbols <= 0.02, symbols > 0.1),
        "mostly_letters": _vote(letters >= 0.93, letters < 0.8),
        "words_have_letters": _vote(bare <= 0.05, bare > 0.25),
        "few_capitals": _vote(upper <= 0.1, upper > 0.25),
        "few_shouts": _vote(shouts <= 0.02, shouts > 0.2),
        "few_repeats": _vote(repeats <= 0.02, repeats > 0.3),
        "usual_word_length": _vote(length.between(3, 10), ~length.between(2, 14)),
        "few_duplicate_lines": _vote((dup <= 0.1) & (f["n_lines"] >= 3), dup > 0.5),
        "varied_words": _vote((distinct >= 0.3) & (f["n_words"] >= 50), (distinct < 0.2) & (f["n_words"] < 2000)),
    }


def _posterior(votes: dict[str, Column], model: LabelModel) -> Column:
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, vote in votes.items():
        g, b = model.on_good[name], model.on_bad[name]
        odds = odds + F.when(vote == 1, math.log(g / (1 - b))).when(vote == -1, math.log((1 - g) / b)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(measured: DataFrame, features_col: str = "features", rounds: int = ROUNDS) -> LabelModel:
    """Estimate the label model over all rows of ``measured`` by expectation-maximisation.

    Votes are taken as independent given the class. No rows, or a rule that always
    abstains: its starting values stay.
    """
    votes = rules(F.col(features_col))
    patterns = measured.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).agg(F.count("*").alias("weight"))
    patterns = cut(patterns.coalesce(1))
    model = LabelModel(0.7, {k: 0.99 for k in votes}, {k: 0.25 for k in votes})
    cols = {k: F.col(k) for k in votes}
    good, bad = F.col("weight") * F.col("post"), F.col("weight") * (1 - F.col("post"))
    for _ in range(rounds):
        row = patterns.withColumn("post", _posterior(cols, model)).agg(
            (F.sum(good) / F.sum("weight")).alias("prior"),
            *((F.sum(F.when(c == 1, good)) / F.sum(F.when(c != 0, good))).alias(f"good_{k}") for k, c in cols.items()),
            *((F.sum(F.when(c == -1, bad)) / F.sum(F.when(c != 0, bad))).alias(f"bad_{k}") for k, c in cols.items()),
        ).first()
        if row["prior"] is None:
            break
        clip = lambda x, old, least, most: old if x is None else min(most, max(least, x))
        model = LabelModel(
            clip(row["prior"], 0.8, 0.01, 0.99),
            {k: clip(row[f"good_{k}"], model.on_good[k], LEAST_ON_GOOD, MOST) for k in votes},
            {k: clip(row[f"bad_{k}"], model.on_bad[k], LEAST_ON_BAD, MOST) for k in votes},
        )
    return model


def judge(measured: DataFrame, model: LabelModel, least: float = 0.5, features_col: str = "features") -> DataFrame:
    """Add ``base_failed``, ``quality`` (posterior that the document is good) and ``kept``.

    ``kept`` is false where ``base_failed``, else ``quality >= least``. Columns of these
    names in the input are replaced; rows are neither added nor dropped.
    """
    f = F.col(features_col)
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
    quality = _posterior(rules(f), model)
    return measured.withColumns({"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= least)})


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Only the documents that the fitted rules keep, with the columns of ``docs``."""
    scratch = "_quality_features"
    measured = features(docs, text_col, scratch)
    model = fit(measured, scratch)
    judged = judge(measured.select(F.struct(*docs.columns).alias("_doc"), scratch), model, features_col=scratch)
    return judged.filter("kept").select("_doc.*")


def op5(docs: DataFrame) -> DataFrame:
    measured = cut(features(docs.select("doc_id", "text")).select("doc_id", "features"))
    judged = judge(measured, fit(measured))
    return judged.select("doc_id", *(F.col("features")[c].alias(c) for c in COUNTS), "base_failed", "kept", "quality")
