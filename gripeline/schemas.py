"""Schemas of the tables that the analytics read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


HISTORY = T.ArrayType(_schema(("period", _S), ("support", _L), ("share", _D), ("lift", _D)))
TABLE_A = _schema(
    ("conversation_id", _S, False), ("created_at", T.TimestampType(), False), ("text", _S), ("l5_id", _S, False), ("sentiment", _S, False),
    *((s, T.IntegerType(), False) for s in ("churn_intent", "financial_harm", "safety_legal", "repeat_contact", "unresolved")),
)
WEEKLY = _schema(("l5_id", _S), ("week", _S), ("volume", _L), ("severity_avg", _D), ("sentiment_avg", _D), ("order_value_sum", _D))
DRIVER = _schema(
    ("l5_id", _S), ("dimension", _S), ("value", _S), ("support", _L), ("share", _D), ("lift", _D), ("p_value", _D), ("significant", _B),
    ("excess", _D), ("period", _S), ("history", HISTORY),
)
NODE = _schema(("id", _S, False), ("type", _S, False), ("props", _S), ("embedding", T.ArrayType(T.FloatType())), ("pack_version", _S), ("updated_at", _S))
EDGE = _schema(("id", _S, False), ("src", _S, False), ("type", _S, False), ("dst", _S, False), ("props", _S), ("updated_at", _S))
RUN = _schema(("run_id", _S, False), ("window", _S), ("n", _L), ("pack_version", _S), ("created_at", _S))
REPLIES = _schema(*((c, _S) for c in ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")))
