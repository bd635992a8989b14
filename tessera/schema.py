"""Schemas of requests and references."""

from __future__ import annotations

from pyspark.sql import types as T

#: A parsed request: nested structs, of which only the last may be null.
REQUEST = (
    "id string, transaction struct<amount:double,installments:int,requested_at:timestamp>, "
    "customer struct<avg_amount:double,tx_count_24h:int,known_merchants:array<string>>, "
    "merchant struct<id:string,mcc:string,avg_amount:double>, "
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:double>, "
    "last_transaction struct<timestamp:timestamp,km_from_current:double>"
)

#: The same with every scalar as text, since one mistyped leaf would make from_json null its whole struct.
RAW_REQUEST = (
    "id string, transaction struct<amount:string,installments:string,requested_at:string>, "
    "customer struct<avg_amount:string,tx_count_24h:string,known_merchants:array<string>>, "
    "merchant struct<id:string,mcc:string,avg_amount:string>, "
    "terminal struct<is_online:string,card_present:string,km_from_home:string>, "
    "last_transaction struct<timestamp:string,km_from_current:string>, _corrupt string"
)

REFERENCE = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType())])
