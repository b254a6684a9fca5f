"""Cyber events: a wide table with a type column, as triples and as JSON-LD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.terms import BOOLEAN, EX, INTEGER, STRING, TYPE, as_quads

EVENT_DDL = (
    "event_id string, type string, source_ip string, dest_ip string, port int, protocol string, process_id bigint, parent_process_id bigint, "
    "command_line string, user string, file_path string, access_type string, success boolean, timestamp bigint"
)
#: Column, its name in triples and JSON-LD, datatype: the event vocabulary, fixed values.
VOCABULARY = (
    ("source_ip", "sourceIP", "sourceIp", STRING), ("dest_ip", "destIP", "destIp", STRING), ("port", "port", "port", INTEGER), ("protocol", "protocol", "protocol", STRING),
    ("process_id", "processId", "processId", INTEGER), ("parent_process_id", "parentProcessId", "parentProcessId", INTEGER), ("command_line", "commandLine", "commandLine", STRING),
    ("user", "user", "user", STRING), ("file_path", "filePath", "filePath", STRING), ("access_type", "accessType", "accessType", STRING), ("success", "success", "success", BOOLEAN), ("timestamp", "timestamp", "timestamp", INTEGER),
)
SECURITY = "https://w3id.org/security#"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from a JSON file that holds one event or an array of them."""
    return spark.read.schema(EVENT_DDL).option("multiLine", "true").json(path)


def event_triples(events: DataFrame) -> DataFrame:
    """Quads of the graph `events`: the type CyberEvent and a triple for each value that an event has.

    An event's subject is event:<event_id>, so events of one second stay apart; without an id it is its time.
    """
    key = F.coalesce(F.col("event_id").cast("string"), F.col("timestamp").cast("string")) if "event_id" in events.columns else F.col("timestamp").cast("string")
    rows = [F.struct(F.lit(TYPE).alias("p"), F.lit(EX + "CyberEvent").alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"))]
    rows += [
        F.struct(F.lit(EX + name).alias("p"), F.col(f"`{c}`").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(dt).alias("o_dt")) for c, name, _, dt in VOCABULARY if c in events.columns
    ]
    each = events.select(F.concat(F.lit("event:"), key).alias("s"), F.explode(F.array(*rows)).alias("t")).where("t.o is not null")
    return as_quads(each.select("s", "t.*", F.lit("named").alias("graph_kind"), F.lit("events").alias("graph_name")))


def event_jsonld(events: DataFrame) -> DataFrame:
    """event_id and a JSON-LD document for each event."""
    key = F.col("event_id").cast("string")
    node = F.struct(F.concat(F.lit("_:event_"), key).alias("@id"), F.col("type").alias("@type"), *(F.col(f"`{c}`").alias(j) for c, _, j, _ in VOCABULARY if c in events.columns))
    context = F.struct(F.lit(SECURITY).alias("@vocab"), *(F.lit(SECURITY + j).alias(j) for _, _, j, _ in VOCABULARY))
    return events.select(key.alias("event_id"), F.to_json(F.struct(context.alias("@context"), F.array(node).alias("@graph"))).alias("jsonld"))


def cyber_events(events: DataFrame) -> DataFrame:
    """The table `events` (event_id, ts, user_id, event_type, value) as cyber events, in a fixed way."""
    kind = F.when(F.col("event_type").isin("click", "signup"), "UserLogin").when(F.col("event_type").isin("view", "purchase"), "NetworkConnection").when(F.col("event_type") == "error", "ProcessExecution")
    login, net, process = (kind == k for k in ("UserLogin", "NetworkConnection", "ProcessExecution"))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    number = lambda c: c.cast("string")
    i, u = F.col("event_id"), F.col("user_id")
    command = F.when(i % 5 == 0, "sudo ls").when(i % 5 == 1, "encrypt.exe --bitcoin").when(i % 5 == 2, "nmap host").otherwise("ls -l")
    net_part = F.when(i % 3 == 0, "10.0.0.").when(i % 3 == 1, "192.168.1.").otherwise("172.16.0.")
    return events.select(
        i.cast("string").alias("event_id"), kind.alias("type"), F.when(login | net, text("10.0.", number(u % 2), ".", number(i % 7))).alias("source_ip"), F.when(net, text(net_part, number(i % 100))).alias("dest_ip"),
        F.when(net, F.lit(443)).alias("port"), F.when(net, F.lit("tcp")).alias("protocol"), F.when(process, i).alias("process_id"), F.lit(None).cast("bigint").alias("parent_process_id"),
        F.when(process, command).alias("command_line"), F.when(login | process, text("u", number(u))).alias("user"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("access_type"),
        F.when(login, F.col("value") >= 20).alias("success"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
    )
