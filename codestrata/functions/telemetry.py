"""Telemetry and request columns: buckets, maps without identifying entries, masks, keyed hashes, clamps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def bucket_duration(ms: Column) -> Column:
    return F.when(ms < 5000, "<5s").when(ms < 15000, "5-15s").when(ms < 30000, "15-30s").otherwise(">30s")


def bucket_files(n: Column) -> Column:
    return F.when(n < 50, "<50").when(n <= 200, "50-200").when(n <= 1000, "200-1000").otherwise("1000+")


def sanitised(props: Column) -> Column:
    """A map without blocked keys and without values that hold '/' (listed ones excepted)."""
    return F.map_filter(props, lambda k, v: ~F.lower(k).isin(fixed.BLOCKED_KEYS) & (F.coalesce(~v.contains("/"), F.lit(True)) | v.isin(fixed.ALLOWED_VALUES)))


def masked_ip(ip: Column) -> Column:
    """The first half of an IPv4 address, or the first two groups of an IPv6 one; the rest as asterisks."""
    v4, v6 = F.split(ip, r"\."), F.split(ip, ":")
    return F.when(F.size(v4) == 4, F.concat(F.array_join(F.slice(v4, 1, 2), "."), F.lit(".***.***"))).when(ip.contains(":"), F.concat(F.array_join(F.slice(v6, 1, 2), ":"), F.lit(":****:****"))).otherwise("***.***")


def keyed_hash(value: Column, secret: str, digits: int) -> Column:
    """The first ``digits`` hex digits of HMAC-SHA256, by two built-in hashes: the key's two pads are constants."""
    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    inner, outer = (F.lit(bytearray(b ^ pad for b in key.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.left(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256), F.lit(digits))


def feedback(score: Column, use: Column, missing: Column, comment: Column) -> Column:
    """struct<score (1 to 5), use (100 characters), missing (10 entries), comment_length (of 500 characters at most)>."""
    return F.struct(
        F.greatest(F.lit(1), F.least(F.lit(5), score)).cast("int").alias("score"),
        F.left(use, F.lit(100)).alias("use"),
        F.slice(missing, 1, 10).alias("missing"),
        F.length(F.left(F.coalesce(comment, F.lit("")), F.lit(500))).alias("comment_length"),
    )


# HTTP status of each error of a source, and the errors after which a client goes on by itself, with the reason it gives.
ERROR_STATUS = {
    "INVALID_GITHUB_URL": 400, "REPO_NOT_FOUND": 404, "UPSTREAM_GITHUB_ERROR": 502, "UPSTREAM_GITHUB_RATE_LIMITED": 429, "FETCH_TIMEOUT": 504, "ARCHIVE_TOO_LARGE": 413,
    "EXTRACTED_TOO_LARGE": 413, "TOO_MANY_FILES": 413, "PATH_TRAVERSAL": 400, "INVALID_ARCHIVE": 400, "UNREADABLE_FILE": 400,
}
FALLBACK_CODES = ["RATE_LIMITED", "RATE_LIMIT_UNAVAILABLE", "UPSTREAM_GITHUB_RATE_LIMITED", "UPSTREAM_GITHUB_ERROR", "FETCH_TIMEOUT"]


def error_status(code: Column) -> Column:
    """HTTP status of an error code; 400 for others, null for none."""
    table = F.create_map(*(F.lit(x) for pair in ERROR_STATUS.items() for x in pair))
    return F.when(code.isNotNull(), F.coalesce(table[code], F.lit(400)))


def fallback_reason(code: Column, offered: Column) -> Column:
    """Why a client goes on without the server after a failure (null: it does not). No code at all is a network error."""
    reason = F.when(code.isin("RATE_LIMITED", "UPSTREAM_GITHUB_RATE_LIMITED"), "rate_limited").when(code == "FETCH_TIMEOUT", "timeout").when(code == "RATE_LIMIT_UNAVAILABLE", "service_unavailable").otherwise("network_error")
    return F.when(code.isNull() | code.isin(FALLBACK_CODES) | F.coalesce(offered, F.lit(False)), reason)


def request_log(requests: DataFrame, secret: str | None = None) -> DataFrame:
    """Log rows of requests (request_id, ts, method, repo, ip, user, duration_ms, files, status, code): addresses masked, repositories hashed, no content."""
    hashed = keyed_hash(F.col("repo"), secret, 16) if secret else F.lit(None).cast("string")
    return requests.select(
        F.col("request_id").alias("requestId"), F.col("ts").alias("timestamp"), "method", hashed.alias("repoIdHash"), masked_ip(F.col("ip")).alias("clientIp"),
        F.when(F.col("user").isNull() | F.col("user").isin("", "anonymous"), "public").otherwise("authenticated").alias("userType"),
        F.col("duration_ms").alias("durationMs"), F.col("files").alias("fileCount"), "status", F.coalesce("code", F.lit("SUCCESS")).alias("resultCode"), F.col("code").alias("failureCategory"),
    )


def captured(events: DataFrame) -> DataFrame:
    """Events (name, props, consent) of those who granted it, with sanitised props: what a sink may be given."""
    return events.where(F.col("consent") == "granted").withColumn("props", sanitised(F.col("props"))).drop("consent")
