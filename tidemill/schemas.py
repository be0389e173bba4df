"""Explicit schemas of the entities; readers select by name, so that fields a reader doesn't know are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

# Fields of the entities.
DDL = {
    "transaction": "txn_id string, account_id string, merchant_id string, amount decimal(12,2), currency string, channel string, device_id string, geo struct<lat: double, lon: double>, tags map<string, string>, shard_id int, event_time timestamp",
    "auth_event": "auth_id string, txn_id string, account_id string, decision string, reason_code string, latency_ms int, event_time timestamp",
    "account": "account_id string, customer_id string, region string, risk_band string, credit_limit decimal(12,2), status string, opened_at timestamp, updated_at timestamp",
    "merchant": "merchant_id string, name string, category string, country string, mcc int, trust_score double, updated_at timestamp",
    "fx_rate": "currency string, rate_to_usd decimal(12,6), event_time timestamp",
    "enriched_transaction": "txn_id string, account_id string, merchant_id string, merchant_name string, merchant_category string, merchant_trust double, amount_usd decimal(12,2), currency string, channel string, auth_decision string, auth_latency_ms int, risk_score double, rules_fired array<string>, shard_id int, subtask_index int, event_time timestamp, processed_at timestamp",
    "account_window_stats": "account_id string, region string, window_start timestamp, window_end timestamp, window_kind string, txn_count bigint, total_usd decimal(14,2), max_usd decimal(14,2), distinct_merchants int, distinct_channels int, late_events bigint, subtask_index int",
    "fraud_alert": "alert_id string, account_id string, rule string, severity string, description string, txn_ids array<string>, total_usd decimal(14,2), detected_at timestamp, event_time timestamp",
    "dead_letter": "dlq_id string, source_topic string, record_key string, reason string, detail string, stage string, subtask_index int, occurred_at timestamp",
}


def schema(entity: str) -> StructType:
    return _parse_datatype_string(DDL[entity])


def conform(df: DataFrame, entity: str) -> DataFrame:
    """The entity's fields by name, cast; missing ones are null, unknown ones go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(entity)])
