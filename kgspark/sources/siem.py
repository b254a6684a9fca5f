"""SIEM events: from actions and anomalies, as each system's payload, to a sink; transports are callables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRODUCT, VERSION = "kgspark", "1.0.0"
#: Path of each system's ingest call, fixed values.
PATHS = {"splunk": "/services/collector/event", "elk": "/_bulk", "chronicle": "/v1/ingest", "custom": ""}
#: Severity of an event in Chronicle's scale, and back; fixed values, lossy as the scale is.
TO_UDM = {"low": "INFORMATIONAL", "medium": "LOW", "high": "MEDIUM", "critical": "HIGH"}
FROM_UDM = {"CRITICAL": "high", "HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
#: Level, event type and verb of each action that is no alert, fixed values.
ACTIONS = {"isolate_host": ("critical", "host_isolation", "isolate"), "block_connection": ("high", "connection_block", "block"), "terminate_process": ("high", "process_termination", "terminate"), "revoke_privileges": ("medium", "privilege_revocation", "revoke")}


def looked_up(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def from_actions(actions: DataFrame, host: str, at: Column | None = None) -> DataFrame:
    """timestamp, level, message, host, source, event_type, severity, details of each security action."""
    kind, c = F.col("action_type"), F.col
    level = F.when(kind == "alert", c("severity")).otherwise(looked_up(kind, {k: v[0] for k, v in ACTIONS.items()}))
    say = lambda *parts: F.concat(*(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    message = (
        F.when(kind == "isolate_host", say("Host isolation required: ", c("host_ip"), " - ", c("reason")))
        .when(kind == "block_connection", say("Connection blocked: ", c("source_ip"), " -> ", c("dest_ip"), " - ", c("reason")))
        .when(kind == "terminate_process", say("Process termination required: ", c("process_id"), " - ", c("reason")))
        .when(kind == "revoke_privileges", say("Privilege revocation required: ", c("user"), " - ", c("privilege"), " - ", c("reason")))
        .otherwise(c("message"))
    )
    verb = looked_up(kind, {k: v[2] for k, v in ACTIONS.items()})
    details = F.when(kind == "alert", c("details")).otherwise(F.to_json(F.struct(c("host_ip").alias("target_host"), "source_ip", "dest_ip", "process_id", "user", "privilege", "reason", verb.alias("action"))))
    event_type = F.when(kind == "alert", F.lit("security_alert")).otherwise(looked_up(kind, {k: v[1] for k, v in ACTIONS.items()}))
    return actions.select((at if at is not None else F.current_timestamp()).alias("timestamp"), level.alias("level"), message.alias("message"), F.lit(host).alias("host"), F.lit(PRODUCT + "-reasoner").alias("source"), event_type.alias("event_type"), level.alias("severity"), details.alias("details"))


def from_anomalies(rows: DataFrame, host: str, at: Column | None = None) -> DataFrame:
    level = F.when(F.col("score") > 2.0, "high").otherwise("medium")
    details = F.to_json(F.struct(F.col("score").alias("anomaly_score"), "threshold", "is_anomaly", "method", "value", "label"))
    said = F.concat(F.lit("Anomaly detected in "), F.col("label"), F.lit(": score="), F.format_string("%.2f", F.col("score").cast("double")))
    return rows.select((at if at is not None else F.current_timestamp()).alias("timestamp"), level.alias("level"), said.alias("message"), F.lit(host).alias("host"), F.lit(PRODUCT + "-anomaly-detector").alias("source"), F.lit("anomaly_detection").alias("event_type"), level.alias("severity"), details.alias("details"))


def payloads(events: DataFrame, system: str, index: str = "main", source_type: str = PRODUCT + ":security") -> DataFrame:
    """A column `payload`: each event in the form of splunk, elk, chronicle or custom."""
    event, c = F.struct(*events.columns), F.col
    form = {
        "splunk": lambda: F.struct(event.alias("event"), F.lit(index).alias("index"), F.lit(source_type).alias("sourcetype"), c("timestamp").alias("time"), "host", F.lit(PRODUCT + "-reasoner").alias("source")),
        "elk": lambda: F.struct(c("timestamp").alias("@timestamp"), "message", "level", event.alias("event"), F.struct(F.lit(PRODUCT + "-reasoner").alias("name"), F.lit(VERSION).alias("version")).alias("service"), F.struct(c("host").alias("name")).alias("host")),
        "chronicle": lambda: F.struct(event.alias("event"), F.struct(c("timestamp").alias("event_timestamp"), F.lit("SECURITY_EVENT").alias("event_type"), F.lit(PRODUCT).alias("vendor_name"), F.lit("reasoner").alias("product_name")).alias("metadata")),
        "custom": lambda: event,
    }
    if system not in form:
        raise ValueError(f"unknown system {system}")
    return events.select(F.to_json(form[system]()).alias("payload"))


def to_udm(events: DataFrame) -> DataFrame:
    """id, timestamp, event_type, source, severity, message, raw_data as Chronicle records."""
    micros = F.unix_micros("timestamp")
    meta = F.struct(F.lit("GENERIC_EVENT").alias("event_type"), micros.alias("event_timestamp"), micros.alias("collected_timestamp"), F.lit(PRODUCT).alias("product_name"), F.lit(VERSION).alias("product_version"), F.col("event_type").alias("product_event_type"), F.lit(PRODUCT).alias("vendor_name"), F.col("id").alias("product_log_id"))
    result = F.array(F.struct(looked_up(F.col("severity"), TO_UDM).alias("severity"), F.array(F.lit("ALERT")).alias("action"), F.lit(0.8).alias("confidence"), F.col("message").alias("summary"), F.col("raw_data").alias("description")))
    return events.select(meta.alias("metadata"), result.alias("security_result"), F.struct("source").alias("additional"))


def from_udm(records: DataFrame) -> DataFrame:
    first = F.get("security_result", 0)
    return records.select(
        F.coalesce("metadata.product_log_id", F.uuid()).alias("id"), F.timestamp_micros("metadata.event_timestamp").alias("timestamp"), F.col("metadata.product_event_type").alias("event_type"), F.lit("chronicle").alias("source"),
        looked_up(first["severity"], FROM_UDM, "medium").alias("severity"), F.coalesce(first["summary"], F.lit("Chronicle event")).alias("message"), F.to_json(F.struct(*records.columns)).alias("raw_data"),
    )


def search(events: DataFrame, condition: Column | None = None, limit: int = 100) -> DataFrame:
    """The latest events that fit, newest first."""
    found = events if condition is None else events.where(condition)
    return found.orderBy(F.col("timestamp").desc()).limit(limit)


def fan_out(*sinks: Callable[[DataFrame, int], None], errors: list | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands a batch to every sink; one that fails does not hinder the others."""

    def write(batch: DataFrame, epoch: int) -> None:
        for sink in sinks:
            try:
                sink(batch, epoch)
            except Exception as e:
                if errors is not None:
                    errors.append((epoch, e))

    return write
