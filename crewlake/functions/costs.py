"""Token cost expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from crewlake.functions.scalars import as_col

# fixed values: USD per million tokens and the payload estimate
PRICE_KEYS = ("in", "out", "cache_read")
CHARS_PER_TOKEN = 4
AVOIDED_USD_PER_MILLION = 3.0


def estimate_cost(label: Column | str, tokens_in: Column | str, tokens_out: Column | str,
                  tokens_cached: Column | str, prices: Mapping[str, Mapping[str, float]]) -> Column:
    """Priced by the first price-list name found in the model part of ``provider/model``.

    The price list is a parameter of a few entries, so it becomes a CASE instead of a
    non-equi join.  NULL when the model is unpriced or no token figure is present.
    """
    model = F.substring_index(F.substring_index(as_col(label), "/", -1), " ", 1)
    counts = [as_col(c) for c in (tokens_in, tokens_out, tokens_cached)]
    case = None
    for name, price in prices.items():
        usd = sum((F.coalesce(n.cast("double"), F.lit(0.0)) * float(price.get(k, 0))
                   for n, k in zip(counts, PRICE_KEYS)), F.lit(0.0))
        hit = model.contains(name)
        value = F.round(usd / 1_000_000, 6)
        case = F.when(hit, value) if case is None else case.when(hit, value)
    if case is None:
        return F.lit(None).cast("double")
    return F.when(F.coalesce(*counts).isNotNull(), case)


def avoided_tokens(payload: Column | str) -> Column:
    return F.floor(F.length(as_col(payload)) / CHARS_PER_TOKEN).cast("bigint")


def avoided_cost(payload: Column | str, usd_per_million: float = AVOIDED_USD_PER_MILLION) -> Column:
    """E21."""
    return F.round(avoided_tokens(payload) / 1_000_000 * usd_per_million, 6)
