"""The ledger: the one physical table, and what its keys mean."""

from __future__ import annotations

from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("logical_key", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("write_nanos", T.LongType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("schema_ver", T.IntegerType(), False),
        T.StructField("persisted_hash", T.StringType(), False),
        T.StructField("payload", T.BinaryType(), False),
    ]
)
#: The kind, the key up to its first colon, is what tables are partitioned by.
KIND = "kind"
QUOTE_SCHEMA = "code string, date string, open double, high double, low double, close double, volume double, prev_close double"
EXPERIMENT_SCHEMA = (
    "verdict struct<fingerprint:string,kind:string,hypothesis_summary:string,level:string,as_of:string,test_index:int,p_raw:double,p_global:double,cached:boolean>"
)
EDGE_SCHEMA = "factor_a string, factor_b string, correlation double, suspect boolean"
EVENT_SCHEMA = "outcome string, slot bigint, spec_fingerprint string, attempt int, exit_code int, message string, write_nanos bigint"
STATUS_SCHEMA = "phase string, slot bigint, spec_fingerprint string, attempt int, last_attempt_time bigint, last_exit_code int, last_verdict string, message string"
#: Validation and role codes.
CODES = {"missing_field": 0x3001, "bad_price": 0x3002, "ohlc": 0x3003, "pct_change": 0x3004, "role": 0x4001}
