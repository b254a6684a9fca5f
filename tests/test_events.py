import json

import pytest
from pyspark.sql import functions as F

from kgspark.operators import detect, rdfs, rules, timeseries
from kgspark.sources import formats, siem
from kgspark.sources.events import EVENT_DDL, event_jsonld, event_triples, read_events
from kgspark.sources.mapping import Literal, QuadGraph
from kgspark.sources.store import QuadStore, imported, inferred, sensor
from kgspark.streaming import pipeline as streams
from kgspark.terms import DOMAIN, EX, INTEGER, RANGE, SUBCLASS, SUBPROPERTY, TYPE, as_quads, quads_of

NAMES = [x.split(" ")[0] for x in EVENT_DDL.split(", ")]


def events(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], EVENT_DDL)


def test_events_with_one_time_stay_apart(spark):
    e = events(spark, {"event_id": "1", "type": "NetworkConnection", "dest_ip": "10.0.0.1", "timestamp": 5}, {"event_id": "2", "type": "UserLogin", "user": "u", "success": True, "timestamp": 5})
    q = event_triples(e)
    assert q.select("s").distinct().count() == 2 and q.where(f"p = '{EX}success'").first()["o"] == "true"
    doc = json.loads(event_jsonld(e).orderBy("event_id").first()["jsonld"])
    assert doc["@graph"][0]["@type"] == "NetworkConnection" and doc["@graph"][0]["destIp"] == "10.0.0.1"


def test_event_files(spark, tmp_path):
    for name, body in (("one", {"type": "UserLogin", "user": "u"}), ("many", [{"type": "UserLogin"}, {"type": "FileAccess"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    assert read_events(spark, f"{tmp_path}/one.json").count() == 1 and read_events(spark, f"{tmp_path}/many.json").count() == 2


def test_malicious_ips(spark):
    e = events(spark, *({"event_id": str(i), "type": "NetworkConnection", "dest_ip": ip, "timestamp": 1} for i, ip in enumerate(["10.0.0.50", "10.0.0.51", "10.0.0.x", "192.168.1.7", "8.8.8.8"])))
    got = detect.malicious_ip_actions(QuadGraph(event_triples(e))).collect()
    assert len(got) == 3 and {r["severity"] for r in got} == {"high"}


def test_lateral_movement(spark):
    login = lambda u, ip, t, ok=True: {"event_id": f"{u}{t}", "type": "UserLogin", "user": u, "source_ip": ip, "success": ok, "timestamp": t}
    e = events(spark, login("a", "1", 0), login("a", "2", 60), login("a", "3", 120), login("b", "1", 0), login("c", "1", 0), login("c", "2", 200), login("c", "3", 301), login("d", "1", 0), login("d", "2", 1), login("d", "1", 2), login("e", "1", 0), login("e", "2", 1, False), login("e", "3", 2))
    assert [tuple(r) for r in detect.lateral_movement(e).collect()] == [("a", 3, 120, 3)]


def test_commands_and_patterns(spark):
    e = events(spark, *({"event_id": str(i), "type": "ProcessExecution", "command_line": c} for i, c in enumerate(["doas socat tcp:7:22 && sudo -s", "packer /all --encrypt --wallet bitcoin", "make test", "check issue"])))
    assert sorted(r["command_line"] for r in detect.dangerous_commands(e).collect()) == ["check issue", "doas socat tcp:7:22 && sudo -s"]
    assert [r["name"] for r in detect.fired_patterns(e).collect()] == ["ransomware_execution"]
    assert detect.pattern_actions(e).count() == 3 and detect.pattern_actions(e.limit(0)).count() == 0
    rows = spark.createDataFrame([("x", 10.0, 2.0), ("y", 2.1, 2.0), ("z", 1.0, 0.0)], "m string, now double, base double")
    assert [r["message"] for r in detect.baseline_alerts(rows, "m", "now", "base").collect()] == ["Baseline deviation: x"]


def test_threat_feed(spark, tmp_path):
    feed = detect.sample_feed(spark)
    seen = spark.createDataFrame([("192.168.1.100",), ("1.1.1.1",)], "ip string")
    assert [r["threat"] for r in detect.threats(seen, feed, "ip", "IpAddress").collect()] == ["Threat detected: malware_c2 (high)"]
    (tmp_path / "feed.json").write_text(json.dumps({"malicious-ip-001": {"id": "malicious-ip-001", "indicator_type": "IpAddress", "value": "1.1.1.1", "threat_type": "scan", "severity": "low", "sources": [], "first_seen": 1, "last_seen": 2, "tags": []}}))
    new = detect.upserted(feed, detect.read_feed(spark, f"{tmp_path}/feed.json"))
    assert new.count() == 3 and [r["threat"] for r in detect.threats(seen, new, "ip", "IpAddress").collect()] == ["Threat detected: scan (low)"]
    assert tuple(detect.feed_statistics(new, detect.sample_sources(spark)).first()) == (3, 2, 1, 1) and detect.feed_json(feed).count() == 3


def test_the_most_severe_indicator_of_a_value_counts(spark):
    row = lambda i, kind, level: (i, "IpAddress", "9.9.9.9", kind, level, [], 1, 2, [])
    feed = spark.createDataFrame([row("c", "scan", "low"), row("b", "botnet", "critical"), row("a", "worm", "Critical"), row("d", "odd", "unheard")], detect.INDICATOR_DDL)
    seen = spark.createDataFrame([("9.9.9.9",)], "ip string")
    assert [r["threat"] for r in detect.threats(seen, feed, "ip", "IpAddress").collect()] == ["Threat detected: worm (Critical)"]


def points(spark, values, label="a"):
    return spark.createDataFrame([(label, i, float(v)) for i, v in enumerate(values)], "label string, timestamp long, value double")


def test_z_scores(spark):
    last = lambda df: df.orderBy("timestamp").collect()[-1]
    r = last(timeseries.z_scores(points(spark, [3.0, 5.0, 4.0, 6.0, 4.5, 3.5, 5.5, 4.2, 3.9, 5.1, 4.4, -40.0]), 11, 2.5))
    assert r["is_anomaly"] and r["method"] == "z_score"
    assert timeseries.z_scores(points(spark, [1.0] * 20)).count() == 0 and timeseries.z_scores(points(spark, range(30)), 9).count() == 0
    r = last(timeseries.security_preset(points(spark, [*range(5, 15), 1000])))
    assert r["is_anomaly"] and r["method"].startswith("ensemble_")
    r = last(timeseries.quartile_ranges(points(spark, [1.0] * 12 + [5.0])))
    assert r["score"] == float("inf") and r["is_anomaly"]
    assert timeseries.trends(points(spark, [3.0])).first()["score"] == 0.0


def test_policies(spark):
    q = quads_of(spark, [(EX + "gate7", EX + "opened", ("2024-05-01",)), (EX + "gate7", EX + "load", ("81.5",))])
    exists = {"type": "TripleExists", "config": {"subject": EX + "gate7", "predicate": EX + "opened", "object": "?day"}}
    compare = lambda left, op, right: {"type": "NumericComparison", "config": {"left": left, "operator": op, "right": {"type": "Constant", "value": right}}}
    more = compare({"type": "Variable", "value": "visits"}, "LessThanOrEqual", 3)

    def run(conditions, action="Alert", **variables):
        spec = {"name": "p", "rules": [{"id": "r", "name": "n", "conditions": conditions, "severity": "Medium", "actions": [{"type": "SecurityAction", "config": {"action_type": action, "message": "m", "details": {}}}, {"type": "ReportViolation", "config": {"level": "Error", "message": "v"}}]}]}
        return rules.Policy.load(json.dumps(spec), **variables).apply(q)

    assert run([exists, more], visits="2").actions.first()["severity"] == "medium" and run([exists, more], visits="4").actions.count() == 0
    with pytest.raises(rules.PolicyError, match="visits has no value"):
        run([exists, more])
    bound = {"type": "VariableBinding", "config": {"variable": "?who", "value": "None"}}
    assert run([bound]).actions.count() == 0 and run([bound], who="None").actions.count() == 1
    load = {"type": "TripleValue", "subject": EX + "gate7", "predicate": EX + "load"}
    assert [run([compare(load, op, 81)]).actions.count() for op in ("GreaterThan", "LessThan", "NotEqual")] == [1, 0, 1]
    assert run([compare(load | {"predicate": EX + "none"}, "NotEqual", 1)]).actions.count() == 0
    assert run([{"type": "Not", "config": exists}]).actions.count() == 0 and run([{"type": "Or", "config": [{"type": "Not", "config": exists}, exists]}]).violations.count() == 1
    assert run([exists], "Quarantine").actions.first()["message"] == "Quarantine required: m" and run([exists]).add is None
    for bad in ({"type": "Odd"}, {"type": "NumericComparison", "config": {"left": {"type": "FunctionCall"}, "operator": "Equal", "right": {"type": "Constant", "value": 1}}}):
        with pytest.raises(rules.PolicyError):
            run([bad])


def test_added_triples_have_terms_of_their_form(spark):
    add = lambda o: {"type": "AddTriple", "config": {"subject": EX + "s", "predicate": EX + "p", "object": o}}
    spec = {"name": "a", "rules": [{"id": "r", "name": "n", "actions": [add(x) for x in ("42", EX + "o", "_:b", "two words: yes", "urn:x:1")]}]}
    got = rules.Policy.load(json.dumps(spec)).apply(quads_of(spark, [])).add
    assert {r["o"]: r["o_kind"] for r in got.collect()} == {"42": "literal", EX + "o": "iri", "_:b": "bnode", "two words: yes": "literal", "urn:x:1": "iri"}


def test_chains_of_rules_settle(spark):
    n = 4
    q = quads_of(spark, [(f"{EX}n{i}", EX + "next", f"{EX}n{i + 1}") for i in range(n)] + [(EX + "n0", TYPE, EX + "Reached")])
    step = rules.InferenceRule("r", [("?x", EX + "next", "?y"), ("?x", TYPE, EX + "Reached")], [("?y", TYPE, EX + "Reached")])
    three = rules.InferenceRule("t", [("?a", EX + "next", "?b"), ("?b", EX + "next", "?c"), ("?c", EX + "next", "?d"), ("?d", TYPE, EX + "Reached")], [("?a", EX + "before", "?d")])
    found = rules.fixpoint(q, [step, three])
    got = {(r["s"], r["p"], r["o"]) for r in found.collect()}
    want = {(f"{EX}n{i}", TYPE, EX + "Reached") for i in range(1, n + 1)} | {(f"{EX}n{i}", EX + "before", f"{EX}n{i + 3}") for i in range(n - 2)}
    assert got == want and found.count() == len(want)


def test_declarative_rules_and_engine(spark):
    q = quads_of(spark, [(EX + "a", EX + "p", EX + "b"), (EX + "b", EX + "p", EX + "c"), (EX + "c", EX + "p", EX + "a"), (EX + "e", TYPE, EX + "CyberEvent"), (EX + "e", EX + "destIP", ("10.0.0.50",))])
    step = rules.InferenceRule("t", [("?x", EX + "p", "?y"), ("?y", EX + "p", "?z")], [("?x", EX + "p", "?z"), ("?x", EX + "seen", Literal("1", INTEGER))])
    assert rules.fixpoint(q, [step]).where(f"p = '{EX}p'").count() == 6
    drop = rules.Policy.load(json.dumps({"name": "d", "priority": 1, "rules": [{"id": "d", "name": "d", "actions": [{"type": "RemoveTriple", "config": {"subject": EX + "a", "predicate": EX + "p", "object": EX + "b"}}]}]}))
    registry = rules.Registry().register(drop).register(rules.MaliciousIpRule()).register(step)
    assert [r.name for r in registry.ordered()] == ["malicious_ip", "d"]
    out = rules.process(q, registry)
    assert out.actions.count() == 1 and out.quads.where(f"s = '{EX}a' and p = '{EX}p' and o = '{EX}b'").count() == 0
    assert out.statistics().first()["actions"] == 1
    stages = [rules.Stage("grow", lambda d: d.unionByName(d), ("max_triples", 5), on_failure="end"), rules.Stage("skip", lambda d: d.limit(0), ("min_triples", 100)), rules.Stage("end", lambda d: d)]
    quads, history = rules.run_pipeline(q, stages)
    assert quads.count() == 10 and history == [("grow", True), ("skip", False), ("end", True)]


def test_engine_broadcasts_no_graph(spark):
    """The files of a graph are a few hundred KB, its rows in memory tens of MB; both joins of the engine must do without a broadcast of it."""
    n = 20_000
    e = spark.range(n).selectExpr("concat('event:', id) AS s", "id")
    typed = e.selectExpr("s", f"'{TYPE}' AS p", f"'{EX}CyberEvent' AS o", "'iri' AS o_kind")
    targets = e.selectExpr("s", f"'{EX}destIP' AS p", "if(id % 2 = 0, '10.0.0.50', '172.16.0.1') AS o", "'literal' AS o_kind")
    name = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "300k")
    try:
        out = rules.process(as_quads(typed.unionByName(targets)), rules.Registry().register(rules.MaliciousIpRule()))
        assert out.actions.count() == n // 2 and out.inferred.count() == 0
    finally:
        spark.conf.set(name, before)


def test_engine_infers_what_follows_and_is_not_there(spark):
    """Types that stand there, that follow and stand there, that follow through them, and one with the odd datatype."""
    names = {x: EX + x for x in ("a", "b", "c", "A", "B", "C", "p", "q")}
    a, b, c, ca, cb, cc, p, q = names.values()
    quads = quads_of(spark, [(a, TYPE, ca), (a, TYPE, cb), (ca, SUBCLASS, cb), (cb, SUBCLASS, cc), (p, DOMAIN, ca), (p, RANGE, cb), (p, SUBPROPERTY, q), (b, p, c), (b, q, c), (c, p, ("text",))])
    quads = quads.unionByName(quads_of(spark, [(c, TYPE, ca)]).withColumn("o_dt", F.lit("odd")))
    want = rdfs.entailed(quads).join(quads, list(rdfs.COLUMNS), "left_anti")
    got = rules.process(quads, rules.Registry()).inferred
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[k] for k in got.columns) for r in want.collect())
    assert {(r["s"], r["o"]) for r in got.where(f"p = '{TYPE}' and o_dt = ''").collect()} == {(a, cc), (b, ca), (b, cb), (b, cc), (c, ca), (c, cb), (c, cc)}


def test_ntriples(spark):
    lines = ["# comment", "", '<a:s> <a:p> "q\\"uo\\\\te\\n\\u00e9" .', '<a:s> <a:p> "hi"@EN .', '<a:s> <a:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <a:g> .', "_:x <a:p> _:y ."]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    q = formats.parse_ntriples(df)
    got = {(r["o"], r["o_kind"], r["o_lang"], r["graph_name"]) for r in q.collect()}
    assert got == {('q"uo\\te\né', "literal", "", None), ("hi", "literal", "en", None), ("5", "literal", "", "a:g"), ("_:y", "bnode", "", None)}
    again = formats.parse_ntriples(formats.to_ntriples(q))
    assert {tuple(r) for r in again.select("s", "p", "o", "o_dt", "o_lang", "graph_name").collect()} == {tuple(r) for r in q.select("s", "p", "o", "o_dt", "o_lang", "graph_name").collect()}
    with pytest.raises(Exception, match="no N-Triples"):
        formats.parse_ntriples(spark.createDataFrame([("oops",)], "value string")).collect()


def test_jsonld(spark):
    doc = {"@context": {"@vocab": "http://v.org/", "ex": EX}, "@graph": [{"@id": "ex:a", "@type": ["Person", "ex:Boss"], "name": "A", "age": 5, "ok": True, "tags": ["x", "y"], "knows": {"@id": "ex:b"}, "said": {"@value": "oui", "@language": "FR"}, "home": {"city": "Rome"}}]}
    q = formats.parse_jsonld(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    got = {(r["p"], r["o"], r["o_kind"]) for r in q.where(f"s = '{EX}a'").collect()}
    assert {(TYPE, "http://v.org/Person", "iri"), (TYPE, EX + "Boss", "iri"), ("http://v.org/name", "A", "literal"), ("http://v.org/age", "5", "literal"), ("http://v.org/tags", "y", "literal"), ("http://v.org/knows", EX + "b", "iri"), ("http://v.org/said", "oui", "literal")} <= got
    assert [r["o"] for r in q.where("p = 'http://v.org/city'").collect()] == ["Rome"]


def test_jsonld_nested_to_any_depth(spark, tmp_path):
    def nested(n):
        return {"name": f"n{n}", "has": nested(n + 1)} if n < 8 else {"name": "n8"}

    value = json.dumps({"@context": {"@vocab": "http://v.org/"}, "@id": "http://v.org/root", "has": nested(1)})
    q = formats.parse_jsonld(spark.createDataFrame([(value,), ("{}",)], "value string")).cache()
    names = {r["s"]: r["o"] for r in q.where("p = 'http://v.org/name'").collect()}
    has = {r["s"]: r["o"] for r in q.where("p = 'http://v.org/has'").collect()}
    at, seen = "http://v.org/root", []
    while at in has:
        at = has[at]
        seen.append(names[at])
    assert seen == [f"n{i}" for i in range(1, 9)] and q.count() == 16
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(value)
    stream = formats.parse_jsonld(spark.readStream.text(f"{tmp_path}/in"))
    with pytest.raises(Exception, match="below 3 levels"):
        stream.writeStream.format("memory").queryName("deep").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()


def test_store(spark, tmp_path):
    store = QuadStore(spark, f"file://{tmp_path}/store")
    assert store.quads().count() == 0
    rows = quads_of(spark, [("a:s", "a:p", ("1",)), ("a:s", "a:p", ("1",)), ("a:t", "a:q", "a:s")])
    store.append(rows, "sensor", "cam", sensor("cam", 0.5), actor="me")
    store.append(rows, prov=imported("a:file", 1))
    store.append(rows.limit(1), "inferred", "r", inferred("rule", "rdfs", ["a", "b"]))
    assert store.quads().count() == 7 and store.graph("sensor", "cam").count() == 3 and store.graphs().count() == 3
    assert store.find(p="a:q").count() == 2 and store.find("a:s", "a:p", "1").count() == 5
    assert store.find(p="a:q", s="a:t").first()["prov"] is not None
    store.clear("sensor", "cam")
    assert store.quads().count() == 4 and store.statistics().first()["audit_entries"] == 4
    assert [r["operation"] for r in store.audit(1).collect()] == ["clear"]
    store.clear()
    assert store.quads().count() == 0


def test_siem(spark):
    kinds = [("isolate_host", "h"), ("block_connection", "h"), ("terminate_process", "h"), ("revoke_privileges", "h"), ("alert", "h")]
    df = spark.createDataFrame([(k,) for k, _ in kinds], "k string")
    from pyspark.sql import functions as F

    made = detect.actions(df, action_type=F.col("k"), host_ip="1", source_ip="2", dest_ip="3", reason="why", user="u", privilege="root", severity="low", message="m", details="{}")
    got = {r["event_type"]: (r["level"], r["message"]) for r in siem.from_actions(made, "host").collect()}
    assert got["connection_block"] == ("high", "Connection blocked: 2 -> 3 - why") and got["security_alert"] == ("low", "m") and len(got) == 5
    ev = siem.from_actions(made, "host")
    assert all(siem.payloads(ev, s).count() == 5 for s in ("splunk", "elk", "chronicle", "custom"))
    records = spark.sql("select 'i' id, timestamp'2020-01-01' timestamp, 'e' event_type, 's' source, 'critical' severity, 'm' message, 'r' raw_data")
    assert siem.from_udm(siem.to_udm(records)).first()["severity"] == "high"
    an = siem.from_anomalies(timeseries.z_scores(points(spark, [10.0] * 10 + [100.0]), 10, 2.0), "h").first()
    assert an["level"] == "high" and an["message"].startswith("Anomaly detected in a")
    with pytest.raises(ValueError):
        siem.payloads(ev, "other")


def test_fan_out_goes_on_after_a_failure(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.createDataFrame([(i, "a", float(i)) for i in range(50)], "event_id long, event_type string, value double").write.parquet(src)
    seen, errors = [], []

    def broken(batch, epoch):
        raise RuntimeError("sink is down")

    work = siem.fan_out(broken, lambda b, e: seen.append(b.count()), errors=errors)
    df = streams.read_stream(spark, src, spark.read.parquet(src).schema)
    streams.micro_batches(df, work, f"{tmp_path}/checkpoint").awaitTermination()
    assert sum(seen) == 50 and len(errors) == len(seen)
    streams.micro_batches(df, work, f"{tmp_path}/checkpoint").awaitTermination()
    assert sum(seen) == 50


def test_action_rules_join_their_conditions(spark):
    sec = rules.SECURITY
    q = quads_of(spark, [("u", sec + "hasSession", "s1"), ("u", sec + "hasSession", "s2"), ("s1", sec + "sourceIp", ("1",)), ("s2", sec + "sourceIp", ("2",)), ("v", sec + "hasSession", "s3"), ("p", TYPE, sec + "ProcessExecution"), ("p", sec + "user", "u"), ("u", sec + "privilegeLevel", ("admin",)), ("p", sec + "commandLine", ("sudo",))])
    lateral = rules.lateral_movement_rule().apply(q).actions
    assert lateral.count() == 4 and json.loads(lateral.orderBy("details").first()["details"])["user"] == "u"
    got = {r["action_type"]: r for r in rules.privilege_escalation_rule().apply(q).actions.collect()}
    assert set(got) == {"isolate_host", "revoke_privileges", "alert"} and got["revoke_privileges"]["user"] == "u" and got["isolate_host"]["host_ip"] is None
    assert len(rules.process_each(q, [rules.Registry().register(rules.lateral_movement_rule()), rules.Registry()])) == 2


def test_turtle(spark, tmp_path):
    from kgspark.sources import turtle

    one = """@prefix ex: <http://example.org/> . # a comment
PREFIX : <http://other/>
@base <http://base/dir/> .
ex:a a ex:T ; ex:p "x\\ty"@EN-gb, 'it', 5, -1.5, 2e3, true ;
  ex:q [ ex:r :z ; ] ; ex:l ( 1 "two" ex:three ) ; ex:none () ; .
<rel#x> ex:long \"\"\"two
"quoted" lines\"\"\" ; ex:date "2024-01-01"^^<http://www.w3.org/2001/XMLSchema#date>, "7"^^ex:kind .
_:n ex:p _:m . _:n ex:p ex:b.c , ex:a\\,b .
[ ex:alone "yes" ] .
[] ex:p ex:end."""
    (tmp_path / "a.ttl").write_text(one)
    (tmp_path / "b.ttl").write_text("_:n <http://example.org/p> <http://example.org/c> .")
    (tmp_path / "c.ttl").write_text("")
    got = turtle.read_turtle(spark, f"{tmp_path}/*.ttl").select("s", "p", "o", "o_kind", "o_dt", "o_lang").collect()
    said = {(r["s"], r["p"].replace(EX, ""), r["o"]) for r in got}
    a = EX + "a"
    assert {(a, TYPE, EX + "T"), (a, "p", "x\ty"), (a, "p", "it"), (a, "p", "5"), (a, "p", "-1.5"), (a, "p", "2e3"), (a, "p", "true")} <= said
    kinds = {r["o"]: (r["o_kind"], r["o_dt"].split("#")[-1], r["o_lang"]) for r in got}
    assert kinds["x\ty"] == ("literal", "langString", "en-gb") and kinds["5"][1] == "integer" and kinds["-1.5"][1] == "decimal" and kinds["2e3"][1] == "double" and kinds["true"][1] == "boolean"
    assert ("http://base/dir/rel#x", "long", 'two\n"quoted" lines') in said and kinds["2024-01-01"][1] == "date" and kinds["7"][1] == EX + "kind"
    (inner,) = [o for s, p, o in said if p == "q"]
    assert inner.startswith("_:") and (inner, "r", "http://other/z") in said
    (cell,) = [o for s, p, o in said if p == "l"]
    rest = {s: o for s, p, o in said if p.endswith("#rest")}
    first = {s: o for s, p, o in said if p.endswith("#first")}
    assert [first[cell], first[rest[cell]], first[rest[rest[cell]]]] == ["1", "two", EX + "three"] and rest[rest[rest[cell]]].endswith("#nil")
    assert [o for _, p, o in said if p == "none"][0].endswith("#nil") and {EX + "b.c", EX + "a,b"} <= {o for _, p, o in said if p == "p"}
    nodes = {s for s, p, o in said if s.endswith("n") and s.startswith("_:") and p == "p"}
    assert len(nodes) == 2, "blank nodes of two documents stay apart"
    assert any(p == "alone" and s.startswith("_:") for s, p, _ in said) and any(o == EX + "end" for *_, o in said)
    for bad in ("ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", '"x" <b> <c> .', "<a> <b> \x00 .", "<a> _:b <c> ."):
        with pytest.raises(turtle.TurtleError):
            list(turtle.Document(bad).triples())


def test_long_series_are_cut_into_blocks(spark, monkeypatch):
    import random

    rng = random.Random(61)
    rows = [(rng.choice(["a", "a", "a", "b"]), i // 3, i, rng.gauss(0, 1) + (40 if i % 97 == 0 else 0)) for i in range(1500)] + [("c", 1, 1, 5.0)]
    df = spark.createDataFrame(rows, "label string, timestamp long, tie long, value double").repartition(5)

    def found(whole):
        out = [timeseries.z_scores(df, 20, 2.0, "tie", whole), timeseries.quartile_ranges(df, 20, 1.5, "tie", whole), timeseries.trends(df, 0.5, 0.3, 10, "tie", whole)]
        return [sorted((r["tie"], r["label"], round(r["score"], 9), round(r["threshold"], 9), r["is_anomaly"]) for r in x.collect()) for x in out]

    plain = [found(False), found(True)]
    monkeypatch.setattr(timeseries, "BLOCK", 90)
    assert [found(False), found(True)] == plain and len(plain[0][2]) == len(rows)
