"""Key text: building, splitting and testing storage keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_PREFIX = "__offset__/"
#: Fixed prefixes of the evidence graph's edges and objects, and of job records.
EDGE_PREFIXES = {"factor": "evidence:factor:", "experiment": "evidence:experiment:", "strategy": "evidence:strategy:", "paper": "evidence:paper:"}
OBJECT_PREFIXES = {"strategy": "strategy:obj:", "paper": "paper:obj:", "review": "review:obj:", "experiment": "strategy:index:"}
JOB_PREFIXES = {"spec": "job:spec:", "status": "job:status:", "events": "job:events:"}
_VERSION = r"^([\s\S]*):v([0-9]{20})$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def version_key(logical_key, seq) -> Column:
    """lk:v and 20 digits."""
    return F.concat(_col(logical_key), F.lit(":v"), F.lpad(_col(seq).cast("string"), 20, "0"))


def version_bounds(logical_key) -> tuple[Column, Column]:
    """Least and greatest version key of a logical key."""
    key = _col(logical_key)
    return F.concat(key, F.lit(":v" + "0" * 20)), F.concat(key, F.lit(":v18446744073709551615"))


def current_key(logical_key) -> Column:
    return F.concat(_col(logical_key), F.lit(":current"))


def is_version_key(key) -> Column:
    return _col(key).rlike(_VERSION)


def is_current_key(key) -> Column:
    return _col(key).endswith(":current")


def is_internal(key) -> Column:
    """Version and pointer keys, which business scans hide."""
    return is_version_key(key) | is_current_key(key)


def parse_version_key(key) -> Column:
    """struct(logical_key, seq decimal(20,0)), split at the last :v; null where it is none."""
    k = _col(key)
    return F.when(
        is_version_key(k),
        F.struct(F.regexp_extract(k, _VERSION, 1).alias("logical_key"), F.regexp_extract(k, _VERSION, 2).cast("decimal(20,0)").alias("seq")),
    )


def device_and_ts(key) -> tuple[Column, Column]:
    """Device and integer time, split at the last colon; both null where there is no integer."""
    pattern = r"^([\s\S]+):([+-]?[0-9]+)$"
    ts = F.regexp_extract(_col(key), pattern, 2).try_cast("bigint")
    return F.when(ts.isNotNull(), F.regexp_extract(_col(key), pattern, 1)), ts


def kind_of(key) -> Column:
    """Text before the first colon."""
    return F.substring_index(_col(key), ":", 1)


def pair_key(a, b) -> Column:
    """The unordered pair of two factors."""
    return F.concat(F.lit("factor:similarity:"), F.least(_col(a), _col(b)), F.lit("|"), F.greatest(_col(a), _col(b)))


def edge_key(family: str, src, dst) -> Column:
    return F.concat(F.lit(EDGE_PREFIXES[family]), _col(src), F.lit(":"), _col(dst))


def object_key(family: str, name) -> Column:
    return F.concat(F.lit(OBJECT_PREFIXES[family]), _col(name))


def job_key(family: str, name) -> Column:
    return F.concat(F.lit(JOB_PREFIXES[family]), _col(name))


def source_role(source) -> Column:
    return F.when(_col(source).startswith("agent:"), "agent").otherwise("engine")


def agent_id(source) -> Column:
    return F.when(_col(source).startswith("agent:"), F.substring(_col(source), F.lit(7), F.char_length(_col(source))))


def agent_source(agent) -> Column:
    return F.concat(F.lit("agent:"), _col(agent))


def is_proposal_key(key) -> Column:
    return _col(key).startswith("proposal:")


def shard_of(key, shards: int) -> Column:
    return F.pmod(F.crc32(_col(key).cast("binary")), F.lit(shards)).cast("int")
