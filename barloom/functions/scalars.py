"""Scalar functions on text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.frames import as_col

# Currency symbols.
CURRENCIES = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}
KEPT = r"[^\p{L}\p{N} _\-.,;:!?()\[\]{}'\"/\\@#$%^&*+=<>]"


def sanitize_text(c, max_length: int | None = None) -> Column:
    """Keeps letters, digits and common punctuation of the first ``max_length`` characters, or of the whole text."""
    c = as_col(c)
    return F.regexp_replace(c if max_length is None else F.substring(c, 1, max_length), KEPT, "")


def format_currency(amount, currency: str = "USD", places: int = 2) -> Column:
    a = as_col(amount)
    return F.concat(F.when(a < 0, "-").otherwise(""), F.lit(CURRENCIES.get(currency, currency + " ")), F.format_number(F.abs(a), places))


def format_number(n, places: int = 2) -> Column:
    return F.format_number(as_col(n), places)


def format_percentage(n, places: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{places}f", as_col(n) * 100), F.lit("%"))


def safe_divide(a, b, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(as_col(a), as_col(b)), F.lit(default))


def decay_weights(n: int, decay: float = 0.5) -> Column:
    """Array of n decreasing weights decay^i that sum to one."""
    total = (1 - decay**n) / (1 - decay) if decay != 1 else float(n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pow(F.lit(decay), i) / total)


def rolling_matrix(values, n: int) -> Column:
    """All runs of n consecutive elements of an array."""
    v = as_col(values)
    starts = F.when(F.size(v) >= n, F.sequence(F.lit(1), F.size(v) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(v, i, F.lit(n)))


def valuation(price, eps, book) -> dict[str, Column]:
    """Price ratios with floors of 0.01 under earnings and book value."""
    return {"pe_ratio": as_col(price) / F.greatest(as_col(eps), F.lit(0.01)), "pb_ratio": as_col(price) / F.greatest(as_col(book), F.lit(0.01))}


def rounded(cols: list[str], digits: int) -> Column:
    """Array of double columns as ``round`` gives them, to the same bits.

    ``round`` writes a double as text first. That is left to rows with a value within 0.001 of a tie or with one whose scaled
    form is too large to tell; in all others the integer nearest to the scaled value is the decimal asked for.
    """
    scale = float(10**digits)
    scaled = [F.col(c) * scale for c in cols]

    def most(xs):
        return F.greatest(*xs) if len(xs) > 1 else xs[0]

    plain = (most([F.abs(s - F.rint(s)) for s in scaled]) < 0.499) & (most([F.abs(s) for s in scaled]) < 1e12)
    # adding zero turns a negative zero into zero, as ``round`` does
    near = F.array(*[F.rint(s) / scale + 0.0 for s in scaled])
    # without any value there is nothing to tell
    return F.when(F.coalesce(plain, F.lit(True)), near).otherwise(F.transform(F.array(*cols), lambda x: F.round(x, digits)))
