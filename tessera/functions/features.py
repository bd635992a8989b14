"""The fourteen features of a request, as columns: all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import DEFAULT_MCC_RISK, MCC_RISK, V, Normalization


def clamp(x: Column) -> Column:
    """x cut to [0, 1]; NaN stays NaN (least() would order it above 1)."""
    return F.when(F.isnan(x), x).when(x < 0, 0.0).otherwise(F.least(x, F.lit(1.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles have it once clamped: a positive amount over zero is 1, zero over zero is 0."""
    zero = F.when(a > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def mcc_risk(mcc: Column, risks: dict[str, float] | None = None, default: float = DEFAULT_MCC_RISK) -> Column:
    """The risk of a category code; unknown and null codes have the default."""
    pairs = [F.lit(x) for kv in (risks or MCC_RISK).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), mcc), F.lit(default))


def unknown_merchant(known: Column, merchant: Column) -> Column:
    """1 unless the merchant is in the list; a null list knows nobody."""
    return (~F.coalesce(F.array_contains(known, merchant), F.lit(False))).cast("double")


def _zero(x: Column, kind: str = "double") -> Column:
    return F.coalesce(x.cast(kind), F.lit(0).cast(kind))


def vectorize(requests: DataFrame, norm: Normalization | None = None, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep, v0..v13 of parsed requests (schema.REQUEST). The session's time zone has to be UTC."""
    n = norm or Normalization()
    tx, customer, merchant, terminal, last = (F.col(c) for c in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    amount = _zero(tx["amount"])
    # div truncates toward zero, so that the minutes are whole
    minutes = F.expr("(unix_seconds(transaction.requested_at) - coalesce(unix_seconds(last_transaction.timestamp), 0L)) div 60")
    columns = [
        clamp(amount / n.max_amount),
        clamp(_zero(tx["installments"]) / n.max_installments),
        clamp(ratio(amount, _zero(customer["avg_amount"])) / n.amount_vs_avg_ratio),
        F.expr("cast((pmod(unix_seconds(transaction.requested_at), 86400L) div 3600) as double)") / 23.0,
        F.weekday(tx["requested_at"]).cast("double") / 6.0,
        F.when(last.isNull(), -1.0).otherwise(clamp(minutes.cast("double") / n.max_minutes)),
        F.when(last.isNull(), -1.0).otherwise(clamp(_zero(last["km_from_current"]) / n.max_km)),
        clamp(_zero(terminal["km_from_home"]) / n.max_km),
        clamp(_zero(customer["tx_count_24h"]) / n.max_tx_count_24h),
        _zero(terminal["is_online"]),
        _zero(terminal["card_present"]),
        unknown_merchant(customer["known_merchants"], merchant["id"]),
        mcc_risk(merchant["mcc"]),
        clamp(_zero(merchant["avg_amount"]) / n.max_merchant_avg_amount),
    ]
    return requests.select(*keep, *[c.alias(v) for c, v in zip(columns, V, strict=True)])
