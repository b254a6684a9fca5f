"""Security detectors over cyber events and their triples, threat intelligence, attack patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.sources.mapping import Graph
from kgspark.terms import EX, TYPE

# Known bad addresses and patterns, fixed values.
BAD_IPS = ("192.168.1.100", "10.0.0.50")
BAD_IP_PATTERNS = (r"^192\.168\.1\.\d+$", r"^10\.0\.0\.\d+$")
# Command fragments that count as dangerous, fixed values.
DANGEROUS = ("sudo", "su", "chmod 777", "rm -rf /", "netcat", "nmap")
# Attack patterns: name, severity, indicators, actions (type, reason or message); fixed values.
ATTACK_PATTERNS = (
    ("ransomware_execution", "critical", ("encrypt", "bitcoin", "ransom", ".encrypted"), (("isolate_host", "Ransomware execution detected"), ("terminate_process", "Ransomware process termination"), ("alert", "Ransomware attack detected"))),
    ("data_exfiltration", "high", ("large_file_transfer", "external_ip", "unusual_traffic"), (("block_connection", "Potential data exfiltration detected"), ("alert", "Data exfiltration attempt"))),
    ("brute_force_login", "medium", ("multiple_failed_logins", "same_user", "rapid_attempts"), (("block_connection", "Brute force login attempts detected"), ("alert", "Brute force attack detected"))),
)
INDICATOR_DDL = "id string, indicator_type string, value string, threat_type string, severity string, sources array<string>, first_seen bigint, last_seen bigint, tags array<string>"
# The sample feed, fixed values.
SAMPLE_FEED = (
    ("malicious-ip-001", "IpAddress", "192.168.1.100", "malware_c2", "high", ["sample_feed"], 1640995200, 1672531200, ["c2", "malware"]),
    ("malicious-ip-002", "IpAddress", "10.0.0.50", "phishing", "medium", ["sample_feed"], 1643673600, 1675209600, ["phishing"]),
    ("malicious-domain-001", "Domain", "malicious-site.example.com", "phishing", "high", ["sample_feed"], 1640995200, 1672531200, ["phishing", "fake_login"]),
)
SOURCE_DDL = "name string, url string, last_updated bigint, confidence double"
SAMPLE_SOURCES = (("Sample Threat Feed", "https://example.com/threat-feed", 1672531200, 0.8),)
ACTION_DDL = "action_type string, host_ip string, source_ip string, dest_ip string, process_id bigint, user string, privilege string, reason string, severity string, message string, details string"


def is_malicious_ip(ip: Column, listed: tuple[str, ...] = BAD_IPS, patterns: tuple[str, ...] = BAD_IP_PATTERNS) -> Column:
    return reduce(lambda a, b: a | b, (ip.rlike(p) for p in patterns), ip.isin(list(listed)))


def is_dangerous_command(command: Column) -> Column:
    return reduce(lambda a, b: a | b, (command.contains(x) for x in DANGEROUS))


def actions(df: DataFrame, **values: Column | str) -> DataFrame:
    """Rows of the action schema with the given columns; the rest is null."""
    out = []
    for field in ACTION_DDL.split(", "):
        name, kind = field.split(" ")
        v = values.get(name)
        out.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return df.select(*out)


def malicious_ip_alerts(graph: Graph) -> DataFrame:
    """(subject, ip): cyber events whose destination is malicious, as often as the triples stand.

    Neither side is small for being few bytes of files, so they meet in a merge join.
    """
    events = graph.scan(p=TYPE, o=EX + "CyberEvent").select("s").hint("merge")
    targets = graph.scan(p=EX + "destIP").select(F.col("s").alias("subject"), F.col("o").alias("ip")).where(is_malicious_ip(F.col("ip")))
    return targets.join(events, F.col("subject") == F.col("s")).select("subject", "ip")


def malicious_ip_actions(graph: Graph) -> DataFrame:
    found = malicious_ip_alerts(graph)
    details = F.to_json(F.struct(F.col("ip"), F.col("subject").alias("event")))
    return actions(found, action_type="alert", severity="high", message=F.concat(F.lit("Connection to malicious IP detected: "), F.col("ip")), details=details)


def lateral_movement(events: DataFrame, window_seconds: int = 300) -> DataFrame:
    """One row for each user who logged in from three addresses in three logins in a row within the window.

    user, session_count (all successful logins), time_span_seconds and unique_ips of the first such run.
    """
    tie = "event_id" if "event_id" in events.columns else "source_ip"
    logins = events.where((F.col("type") == "UserLogin") & F.col("success")).select("user", F.col("timestamp").alias("t"), F.col(tie).alias("tie"), F.col("source_ip").alias("ip"))
    of_user = Window.partitionBy("user")
    w = of_user.orderBy("t", "tie")
    back = lambda c, k: F.lag(c, k).over(w)
    rows = logins.select("user", "t", "tie", "ip", (F.col("t") - back("t", 2)).alias("span"), back("ip", 1).alias("ip1"), back("ip", 2).alias("ip2"), F.count("*").over(of_user).alias("session_count"))
    hits = rows.where((F.col("span") <= window_seconds) & (F.col("ip") != F.col("ip1")) & (F.col("ip") != F.col("ip2")) & (F.col("ip1") != F.col("ip2")))
    first = hits.withColumn("_at", F.row_number().over(w)).where("_at = 1")
    return first.select("user", "session_count", F.col("span").alias("time_span_seconds"), F.lit(3).cast("long").alias("unique_ips"))


def dangerous_commands(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == "ProcessExecution").where(is_dangerous_command(F.col("command_line")))


def fired_patterns(events: DataFrame) -> DataFrame:
    """name, severity, hits of each attack pattern that any executed command fires: one pass over the events."""
    command = F.col("command_line")
    hit = lambda marks: F.count_if((F.col("type") == "ProcessExecution") & reduce(lambda a, b: a | b, (command.contains(m) for m in marks)))
    counts = events.agg(*(hit(marks).alias(name) for name, _, marks, _ in ATTACK_PATTERNS))
    rows = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.col(name).alias("hits")) for name, severity, _, _ in ATTACK_PATTERNS))
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("hits > 0")


def pattern_actions(events: DataFrame) -> DataFrame:
    """All actions of the patterns that fire, each once."""
    listed = [(name, severity, kind, said) for name, severity, _, own in ATTACK_PATTERNS for kind, said in own]
    table = events.sparkSession.createDataFrame(listed, "name string, pattern_severity string, kind string, said string")
    found = table.join(fired_patterns(events).select("name"), "name", "left_semi")
    alert = F.col("kind") == "alert"
    details = F.when(alert, F.to_json(F.struct(F.col("name").alias("pattern"))))
    return actions(found, action_type=F.col("kind"), reason=F.when(~alert, F.col("said")), severity=F.when(alert, F.col("pattern_severity")), message=F.when(alert, F.col("said")), details=details)


def baseline_deviation(current: Column, baseline: Column, threshold: float) -> Column:
    """|current - baseline| / baseline over the threshold; the divisor keeps its sign, zero gives null."""
    return F.try_divide(F.abs(current - baseline), baseline) > threshold


def baseline_alerts(rows: DataFrame, metric: str, current: str, baseline: str, threshold: float = 0.5) -> DataFrame:
    found = rows.where(baseline_deviation(F.col(current), F.col(baseline), threshold))
    details = F.to_json(F.struct(F.col(metric).alias("metric"), F.col(current).alias("current"), F.col(baseline).alias("baseline")))
    return actions(found, action_type="alert", severity="medium", message=F.concat(F.lit("Baseline deviation: "), F.col(metric)), details=details)


# Threat intelligence.
#: From the least to the most severe.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def sample_feed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE_FEED), INDICATOR_DDL)


def sample_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE_SOURCES), SOURCE_DDL)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Indicators from a JSON object of id to indicator."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<" + INDICATOR_DDL.replace(", ", ",").replace(" ", ":") + ">>"
    return text.select(F.explode(F.from_json("value", kind)).alias("id_", "i")).select(F.coalesce("i.id", "id_").alias("id"), *(F.col(f"i.{c}") for c in ("indicator_type", "value", "threat_type", "severity", "sources", "first_seen", "last_seen", "tags")))


def feed_json(feed: DataFrame) -> DataFrame:
    """A row for each indicator: its JSON."""
    return feed.select(F.to_json(F.struct(*feed.columns)).alias("value"))


def upserted(feed: DataFrame, more: DataFrame) -> DataFrame:
    """feed with the indicators of more in place of those of the same id."""
    return feed.join(more.select("id"), "id", "left_anti").unionByName(more)


def threats(values: DataFrame, feed: DataFrame, value: str, indicator_type: str) -> DataFrame:
    """values that the feed lists, with threat_type, severity and the message. Spark broadcasts a small feed by its size.

    Of several indicators of one value the most severe counts, then the one with the smallest id.
    """
    rank = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in SEVERITIES)), F.lower("severity")), F.lit(0))
    worst = F.min(F.struct((-rank).alias("rank"), "id", "threat_type", "severity")).alias("worst")
    own = feed.where(F.col("indicator_type") == indicator_type).groupBy(F.col("value").alias("_value")).agg(worst).select("_value", "worst.threat_type", "worst.severity")
    said = F.concat(F.lit("Threat detected: "), F.col("threat_type"), F.lit(" ("), F.col("severity"), F.lit(")"))
    return values.join(own, F.col(value) == F.col("_value")).drop("_value").withColumn("threat", said)


def feed_statistics(feed: DataFrame, sources: DataFrame) -> DataFrame:
    of = lambda k: F.count_if(F.col("indicator_type") == k)
    return feed.agg(F.count("*").alias("total_indicators"), of("IpAddress").alias("ip_indicators"), of("Domain").alias("domain_indicators")).crossJoin(sources.agg(F.count("*").alias("sources")))
