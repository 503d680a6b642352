"""Bundles, package prices and price changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanula.functions.dates import ColumnOrName, as_col
from campanula.functions.rules import bucket, flag
from campanula.operators.joining import key_weights, role_join
from campanula.operators.snapshot import latest_ties

# --- fixed values -----------------------------------------------------------
DVR_CHARGE = 5  # monthly charge of a recorder
DISCOUNT = 15  # yearly discount that marks a discounted offer
CODE_LENGTH = 5
ABSENT = " "  # product not part of the bundle
# ---------------------------------------------------------------------------


def resolve_bundle(codes: Sequence[ColumnOrName]) -> Column:
    """The one package code all present products agree on.

    A blank means the product is absent, NULL means unknown.  Unknown products
    and products that disagree give NULL; all absent gives a blank.  Blanks
    sort before codes, so the greatest value is the only code there may be.
    """
    parts = [F.substring(as_col(c), 1, CODE_LENGTH) for c in codes]
    top = F.greatest(*parts)
    agree = F.lit(True)
    for part in parts:
        agree = agree & part.isin(ABSENT, top)
    return F.when(agree, top)


def bundle_up(prefix: str = "") -> Column:
    return resolve_bundle([f"{prefix}cable_up", f"{prefix}internet_up", f"{prefix}phone_up"])


def bundle_by_direction() -> Column:
    """Downgrades carry their new products in the ``*_down`` columns."""
    up = F.col("ord_typ") != "DOWNGRADE"

    def pick(product: str) -> Column:
        return F.when(up, F.col(f"{product}_up")).otherwise(F.col(f"{product}_down"))

    return resolve_bundle([pick("cable"), pick("internet"), pick("phone")])


def has_dvr(stb: ColumnOrName) -> Column:
    return flag(F.lower(as_col(stb)).like("%dvr%"))


def package_price_panel(prices: DataFrame, how: str = "min") -> DataFrame:
    """One price and one description per package; ``how`` is ``min``, ``max`` or ``any``.

    ``any`` may be any of the prices; the smallest is taken to be repeatable.
    """
    pick = F.max if how == "max" else F.min
    return prices.groupBy("package_code").agg(
        F.round(pick("price"), 2).alias("price"), F.min("description").alias("description")
    )


def asset_price(assets: DataFrame) -> DataFrame:
    """Sum of the charges of each package on its latest day, two decimals."""
    latest = latest_ties(assets, ["package_code"], "dt")
    return latest.groupBy("package_code").agg(F.round(F.sum("charge"), 2).alias("price"))


def code_weights(df: DataFrame, code: str) -> DataFrame:
    """Rows per package code, for :func:`old_new_price`."""
    return key_weights(df, [code])


def old_new_price(
    df: DataFrame,
    prices: DataFrame,
    front_book: DataFrame,
    *,
    old_code: str,
    new_code: str,
    old_dvr: str = "old_dvr",
    new_dvr: str = "new_dvr",
    weights: tuple[DataFrame, DataFrame] | None = None,
    **sizes: int,
) -> DataFrame:
    """Add old and new price; a recorder adds its charge to catalogue packages.

    Prices and catalogue become one small table with a row per package, so
    each role costs one join.  Codes have few values and many rows have none:
    both joins are split by weight.  ``weights`` of old and new codes from a
    table at hand (:func:`code_weights`) save counting ``df``.
    """
    listed = front_book.select("package_code").distinct().withColumn("listed", F.lit(1))
    dim = prices.select("package_code", "price").join(listed, "package_code", "full_outer")
    known = dict(zip(("_old", "_new"), weights, strict=True)) if weights else None
    priced = role_join(df, dim, "package_code", {"_old": old_code, "_new": new_code}, known, **sizes)

    def price(role: str, dvr: str) -> Column:
        extra = F.when((F.col(dvr) == 1) & F.col(f"{role}_listed").isNotNull(), DVR_CHARGE).otherwise(0)
        return F.col(f"{role}_price") + extra

    return priced.withColumns(
        {
            "old_listed": flag(F.col("_old_listed").isNotNull()),
            "new_listed": flag(F.col("_new_listed").isNotNull()),
            "old_price": price("_old", old_dvr),
            "new_price": price("_new", new_dvr),
        }
    ).drop("_old_price", "_new_price", "_old_listed", "_new_listed")


def price_change() -> Column:
    """New minus old price; nothing new counts as no change."""
    new, old = F.col("new_price"), F.col("old_price")
    return F.when(new.isNull(), 0.0).otherwise(F.round(new - old, 2))


def direction() -> Column:
    change = F.round(F.col("new_price") - F.col("old_price"), 2)
    return bucket([(change > 0, "UP"), (change < 0, "DOWN")], "EQUAL")


def price_delta(df: DataFrame, promised: str | None = None) -> DataFrame:
    """Price change, its direction and sign flags, and the category against
    the promised difference."""
    out = df.withColumns({"price_dif": price_change(), "up_down": direction()})
    extra = {
        "positive_price_dif": flag(F.col("price_dif") > 0),
        "negative_price_dif": flag(F.col("price_dif") < 0),
    }
    if promised is not None:
        extra["price_category"] = bucket(
            [
                (F.col("up_down") == "DOWN", "A. DOWNGRADE"),
                (F.col("up_down") == "EQUAL", "B. NO PRICE INCREASE"),
                (F.col("price_dif") - F.col(promised) < 0, "C. MIG TO PLAN LOWER THAN TARGET"),
            ],
            "D. MIG TO TARGET",
        )
    return out.withColumns(extra)


def discounted_arpu_change(discount: str, new_code: str, target_code: str) -> Column:
    """Monthly change after spreading the yearly discount over twelve months,
    for customers who took the discounted target package."""
    took = (F.col(discount) == DISCOUNT) & (F.col(new_code) == F.col(target_code))
    net = F.round(F.col("new_price") - F.col("old_price") - F.lit(DISCOUNT) / 12, 2)
    return F.when(took, net).otherwise(price_change())


def delta_arpu_adjusted(
    df: DataFrame, *, new_code: str, target_code: str, discount: str, monthly_discount: float = DISCOUNT / 12
) -> DataFrame:
    """Add the new price with recorder and the change net of discount.

    ``monthly_discount`` is 1.25 by default; pass 1 for the whole-number
    division some engines would do.
    """
    new = F.col("new_price") + F.when(F.col("new_dvr") == 1, DVR_CHARGE).otherwise(0)
    took = (F.col(new_code) == F.col(target_code)) & (F.col(discount) == DISCOUNT)
    less = F.when(took, monthly_discount).otherwise(0.0)
    return df.withColumns(
        {
            "new_price_dvr": F.round(new, 2),
            "delta_arpu": F.round(new - less - F.col("old_price"), 2),
        }
    )
