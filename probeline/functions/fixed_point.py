"""Fixed-point expressions of the queries; amounts are whole hundredths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def discounted(price: Column, discount: Column) -> Column:
    """price * (1 - discount), in ten-thousandths."""
    return price * (100 - discount)


def charged(price: Column, discount: Column, tax: Column) -> Column:
    """price * (1 - discount) * (1 + tax), in millionths."""
    return discounted(price, discount) * (100 + tax)


def truncated_average(total: str, count: str) -> Column:
    """A sum over a count in the sum's own scale, cut towards zero."""
    return F.expr(f"{total} div {count}")


def percentage(part: str, whole: str) -> Column:
    """100 * part / whole in millionths; null if whole is too small to divide by.

    Decimals of 38 digits, because a large relation's sums times 100,000 don't
    fit into a long.
    """
    return F.expr(f"cast((100 * (cast({part} as decimal(33,0)) * 1000)) div nullif({whole} div 1000, 0) as long)")
