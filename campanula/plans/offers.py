"""Offer attributes, attribute counts, and catalogue offers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campanula.functions.rules import flag, value_map
from campanula.operators.grouping import conditional_max
from campanula.operators.joining import split_join, successor
from campanula.plans.pricing import DVR_CHARGE, has_dvr

# --- fixed values: video service of the profile -> name in the catalogue -----
VIDEO_SERVICES = {
    "BASIC": "Basic",
    "BROADCAST": "Broadcast",
    "CHOICE PACK": "Choice Pack",
    "ESP PRIMERA": "EDP",
    "EXP BASIC": "EXP Basic",
    "LOCAL CHOICE": "Local Choice",
    "TU MUNDO": "Tu Mundo",
    "ULTIMATE": "Ultimate",
    "UPICK": "UPICK",
}
# play types that include each product; the spaces belong to the values
PLAYS_WITH_INTERNET = ("3P Video HSD Voice", "2P HSD Voice", "2P Video HSD ", "1P HSD ")
PLAYS_WITH_VIDEO = ("3P Video HSD Voice", "2P Video Voice", "2P Video HSD ", "1P Video ")
PLAYS_WITH_VOICE = ("3P Video HSD Voice", "2P HSD Voice", "2P Video Voice", "1P Voice")
# ---------------------------------------------------------------------------


def on_channel(name: str) -> Column:
    return F.lower("channel") == name


def of_type(name: str) -> Column:
    return F.lower("offer_type") == name


def attribute_columns() -> dict[str, tuple[Column | None, str]]:
    """Attribute name -> (condition on the offer row or None, offer column)."""
    email = on_channel("email")
    return {
        "from_package": (None, "pkg_cde"),
        "email_from_speed": (email, "hsd_service"),
        "email_to_package": (email, "recommendedpkg"),
        "email_to_speed": (email, "to_speed_name"),
        "email_discount": (email, "discount"),
        "single_recommended_ms": (of_type("single"), "recommended_ms"),
        "multiple_recommended_ms": (of_type("multiple"), "recommended_ms"),
        "email_stb": (email, "stb"),
        "email_pay_difference": (email, "delta_arpu"),
        "regime": (None, "regime"),
        "email_next_action_ms": (email, "next_best_action_ms"),
        "email_time_frame": (email, "time_frame"),
        "email_template": (email, "param_1"),
        "email_message": (email, "param_2"),
        "email_call_to_action": (email, "param_3"),
        "email_subject": (email, "param_4"),
        "email_link": (email, "link"),
        "email_link_expiry_ms": (email, "link_exp_ms"),
        "email_link_ms": (email, "link_ms"),
    }


def offer_attributes(offers: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per account with the chosen attributes, in one aggregation."""
    columns = attribute_columns()
    chosen = {n: columns[n] for n in names} if names else columns
    return conditional_max(offers, ["account_no"], chosen)


# attribute checks: name -> (attribute, predicate on its per-account value)
ATTRIBUTE_CHECKS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "email_call_to_action": ("email_call_to_action", lambda c: F.lower(c).like("%si deseas el%")),
    "email_discount": ("email_discount", lambda c: c >= 0),
    "email_next_best_action": ("email_next_action_ms", lambda c: c.isNotNull()),
    "email_pay_difference": ("email_pay_difference", lambda c: c > 0),
    "email_stb_code": ("email_stb", lambda c: c.isNotNull()),
    "email_time_frame": ("email_time_frame", lambda c: F.lower(c).like("afternoon")),
    "email_to_speed": ("email_to_speed", lambda c: c.isNotNull()),
    "email_stb_blank": ("email_stb", lambda c: (c == " ") | c.isNull()),
    "email_from_speed": ("email_from_speed", lambda c: c.isNotNull()),
    "from_package": ("from_package", lambda c: c.isNotNull()),
    "message_subject": ("email_subject", lambda c: F.lower(c).like("%velocidad%")),
    "multiple_recommended": ("multiple_recommended_ms", lambda c: c.isNotNull()),
    "single_recommended": ("single_recommended_ms", lambda c: c.isNotNull()),
    "offer_regime": ("regime", lambda c: F.lower(c).like("%control%")),
    "email_message_text": ("email_message", lambda c: c.isNotNull()),
    "email_template_type": ("email_template", lambda c: c == "1"),
}
# checks on single offer rows: name -> predicate
ROW_CHECKS: dict[str, Callable[[], Column]] = {
    "offer_channel": lambda: F.lower("channel").like("%call%center%"),
    "offer_type": lambda: F.lower("offer_type").like("%single%"),
    "rank_order": lambda: F.col("offer_rank") == 1,
    "reward": lambda: F.col("reward") > 0.5,
}


def offer_attribute_count(base: DataFrame, offers: DataFrame, check: str, key: str = "account_no") -> DataFrame:
    """How many accounts of ``base`` pass an attribute check.

    The offers shrink to one row per account before they meet the base.  A
    check that accepts NULL also counts accounts without any offer.
    """
    accounts = base.select(key).distinct()
    if check in ROW_CHECKS:
        kept = accounts.join(offers.where(ROW_CHECKS[check]()).select(key).distinct(), key, "left_semi")
    else:
        attribute, passes = ATTRIBUTE_CHECKS[check]
        facts = offer_attributes(offers, [attribute])
        kept = accounts.join(facts, key, "left").where(passes(F.col(attribute)))
    return kept.agg(F.count(key).alias("accounts"))


def offer_attribute_counts(base: DataFrame, offers: DataFrame, key: str = "account_no") -> DataFrame:
    """Every attribute check at once: one pass over the offers and one join.

    Returns one row per check with the number of accounts that pass.
    """
    attributes = attribute_columns()
    aggregates = [
        F.max(F.col(value) if condition is None else F.when(condition, F.col(value))).alias(name)
        for name, (condition, value) in attributes.items()
    ]
    aggregates += [F.bool_or(rule()).alias(f"row_{name}") for name, rule in ROW_CHECKS.items()]
    wide = base.select(key).distinct().join(offers.groupBy(key).agg(*aggregates), key, "left")
    passed = {name: rule(F.col(attribute)) for name, (attribute, rule) in ATTRIBUTE_CHECKS.items()}
    passed |= {name: F.col(f"row_{name}") for name in ROW_CHECKS}
    counts = wide.agg(*[F.count_if(rule).alias(name) for name, rule in passed.items()])
    return counts.unpivot([], list(passed), "attribute", "accounts")


def offer_facts(
    offers: DataFrame, facts: Mapping[str, Column], key: str = "account_no", extra: Sequence[Column] = ()
) -> DataFrame:
    """One row per account: whether any single offer row meets each condition."""
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in facts.items()]
    return offers.groupBy(key).agg(*flags, *extra)


def catalogue_key(profile: DataFrame) -> DataFrame:
    """Profile columns in the catalogue's terms."""
    return profile.withColumns(
        {
            "connection": F.when(F.col("drop_type") == "COAX", "Coax Trad").otherwise("FTTH"),
            "play": F.substring("play_type", 1, 2),
            "tv": value_map("video_service", VIDEO_SERVICES),
            "has_internet": flag(F.col("play_type").isin(*PLAYS_WITH_INTERNET)),
            "has_video": flag(F.col("play_type").isin(*PLAYS_WITH_VIDEO)),
            "has_voice": flag(F.col("play_type").isin(*PLAYS_WITH_VOICE)),
            "dvr": has_dvr("stb_sc"),
        }
    )


LINE_UP = ["connection", "play", "tv", "has_internet", "has_video", "has_voice"]
PRICE_SPAN = 16.0  # prices that are sorted together


def speed_blocks(speeds: DataFrame) -> DataFrame:
    """Distinct speeds of a line-up with their place from the fastest, and the
    blocks of 1, 2, 4, ... places each lies in."""
    by_speed = Window.partitionBy(*LINE_UP)
    placed = speeds.withColumns(
        {
            "place": F.row_number().over(by_speed.orderBy(F.col("speed_to").desc())),
            "_levels": F.ceil(F.log2(F.count(F.lit(1)).over(by_speed) + 1)).cast("int"),
        }
    )
    return placed.withColumn("level", F.explode(F.sequence(F.lit(0), "_levels"))).select(
        *LINE_UP, "speed_to", "place", "level", F.expr("shiftright(place - 1, level)").alias("block")
    )


def covering_blocks(df: DataFrame, places: str) -> DataFrame:
    """One row for each block of the unique set that covers the first ``places`` places."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.col(places).bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) != 0)
    return df.withColumn("level", F.explode(bits)).withColumn("block", F.expr(f"shiftleft(shiftright({places}, level + 1), 1)"))


def catalogue_prices(front_book: DataFrame) -> DataFrame:
    """The catalogue reduced to what can be chosen: per line-up and price the fastest package."""
    fastest = F.struct(-F.col("speed"), "package_code")
    reduced = (
        front_book.withColumns(
            {
                "has_voice": flag(F.col("phone").isNotNull()),
                "has_video": flag(F.col("tv").isNotNull()),
                "has_internet": flag(F.col("modem").isNotNull()),
            }
        )
        .groupBy(*LINE_UP, F.col("price").alias("price_to"))
        .agg(F.min_by(F.struct("package_code", "speed"), fastest).alias("_package"))
    )
    return reduced.select(*LINE_UP, "price_to", F.col("_package.speed").alias("speed_to"), F.col("_package.package_code").alias("package_to"))


def bau_offer(profile: DataFrame, front_book: DataFrame, span: float = PRICE_SPAN, **sizes: int) -> DataFrame:
    """Cheapest catalogue package that keeps the line-up, is at least as fast
    and costs more than today (a recorder adds its charge to the new price).
    Of packages with that price, the fastest.

    Customers shrink to distinct questions (line-up, speed, price) first.  The
    speeds of a line-up are placed from the fastest; every package is filed in
    the blocks of 1, 2, 4, ... places that hold its speed, and the speeds a
    question allows are a few such blocks.  In each block the answer is the
    next higher price, found by merging questions and prices in sorted spans.
    So no list is held per line-up and nothing is paired; the cost is that of
    sorting, times the logarithm of the number of speeds.  Answers return to
    the customers by a join that splits questions many customers share.
    """
    question = [*LINE_UP, "_extra", "speed_from", "price_from"]
    customers = catalogue_key(profile).select(
        "account_no",
        F.col("connection").alias("drop_kind"),
        *LINE_UP,
        F.col("package_code").alias("package_from"),
        F.col("total_charge").alias("price_from"),
        F.col("down_speed").alias("speed_from"),
        F.when(F.col("dvr") == 1, DVR_CHARGE).otherwise(0).alias("_extra"),
    )
    questions = customers.dropna(subset=question).groupBy(*question).agg(F.count(F.lit(1)).alias("_rows"))

    prices = catalogue_prices(front_book).dropna(subset=[*LINE_UP, "price_to", "speed_to"])
    blocks = speed_blocks(prices.select(*LINE_UP, "speed_to").distinct())
    speeds = blocks.where(F.col("level") == 0).select(*LINE_UP, F.col("speed_to").alias("speed_from"), "place")
    allowed = successor(questions.select(*LINE_UP, "speed_from").distinct(), speeds, LINE_UP, "speed_from", "place", strict=False)
    asked = covering_blocks(questions.join(allowed, [*LINE_UP, "speed_from"]), "place").withColumn("_at", F.col("price_from"))

    answer = F.struct("price_to", (-F.col("speed_to")).alias("slowness"), "package_to").alias("_answer")
    filed = prices.join(blocks, [*LINE_UP, "speed_to"]).withColumn("_extra", F.explode(F.array(F.lit(0), F.lit(DVR_CHARGE))))
    filed = filed.select(*LINE_UP, "level", "block", "_extra", (F.col("price_to") + F.col("_extra")).alias("_at"), answer)
    found = successor(asked, filed, [*LINE_UP, "level", "block", "_extra"], "_at", "_answer", width=span)
    best = found.groupBy(*question).agg(F.min("_answer").alias("_best"))

    weights = questions.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(question)], "_rows")
    chosen = split_join(customers, best, {c: c for c in question}, {"_best": "_best"}, how="inner", weights=weights, **sizes)
    return chosen.select(
        "account_no", "drop_kind", "package_from", "price_from", "speed_from",
        "_best.price_to", (-F.col("_best.slowness")).alias("speed_to"), "_best.package_to",
        (F.col("_best.price_to") - F.col("price_from")).alias("delta_price"),
    )
