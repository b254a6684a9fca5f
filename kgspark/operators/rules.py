"""Rules over quads: a registry, declarative rules to their fixpoint, JSON policies, and the engine around them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.checkpoints import counted, discard, saved, small
from kgspark.operators.closure import FixpointError
from kgspark.operators.detect import ACTION_DDL, actions, malicious_ip_actions
from kgspark.operators.rdfs import COLUMNS, entailed
from kgspark.plans.compiler import Compiler
from kgspark.plans.syntax import Pattern, Var
from kgspark.sources.mapping import Literal, QuadGraph
from kgspark.terms import TYPE, as_quads

TRIPLE_DDL = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
VIOLATION_DDL = "level string, message string, s string, p string, o string, rule_name string, context string"


@dataclass
class RuleResult:
    """Tables, or None for none."""

    add: DataFrame | None = None
    remove: DataFrame | None = None
    actions: DataFrame | None = None
    violations: DataFrame | None = None


class Rule(Protocol):
    name: str
    priority: int

    def apply(self, quads: DataFrame) -> RuleResult: ...


class ValidationRule(Protocol):
    name: str

    def validate(self, quads: DataFrame) -> DataFrame: ...


@dataclass
class Registry:
    """Rules run by priority, highest first, and by order of registration among equals."""

    rules: list[Rule] = field(default_factory=list)
    validations: list[ValidationRule] = field(default_factory=list)
    inferences: list[InferenceRule] = field(default_factory=list)

    def register(self, rule: object) -> Registry:
        where = self.inferences if isinstance(rule, InferenceRule) else self.rules if hasattr(rule, "apply") else self.validations
        where.append(rule)
        return self

    def ordered(self) -> list[Rule]:
        return sorted(self.rules, key=lambda r: -getattr(r, "priority", 0))

    def apply_all(self, quads: DataFrame) -> RuleResult:
        found = [r.apply(quads) for r in self.ordered() if getattr(r, "should_apply", lambda q: True)(quads)]
        spark = quads.sparkSession
        pick = lambda name, ddl: united([getattr(r, name) for r in found], spark, ddl)
        return RuleResult(pick("add", TRIPLE_DDL), pick("remove", TRIPLE_DDL), pick("actions", ACTION_DDL), pick("violations", VIOLATION_DDL))

    def validate_all(self, quads: DataFrame) -> DataFrame:
        return united([v.validate(quads) for v in self.validations], quads.sparkSession, VIOLATION_DDL)


def united(tables: list[DataFrame | None], spark, ddl: str) -> DataFrame:
    there = [t for t in tables if t is not None]
    return reduce(DataFrame.unionByName, there) if there else spark.createDataFrame([], ddl)


class MaliciousIpRule:
    name, priority = "malicious_ip", 10

    def apply(self, quads: DataFrame) -> RuleResult:
        return RuleResult(actions=malicious_ip_actions(QuadGraph(quads)))


# Declarative rules.
def term(text: str | Literal) -> object:
    return Var(text[1:]) if isinstance(text, str) and text.startswith("?") else text


@dataclass
class InferenceRule:
    """conditions and conclusions are triples of IRIs, Literals and variables `?x`; shared variables join."""

    name: str
    conditions: list[tuple]
    conclusions: list[tuple]

    def infer(self, quads: DataFrame, fresh: DataFrame | None = None, at: int = 0) -> DataFrame:
        """What follows from quads; with fresh, what follows with one of these in the place of condition `at`."""
        patterns = [Pattern(*(term(x) for x in c)) for c in self.conditions]
        if fresh is None:
            rel = Compiler(QuadGraph(quads)).triples(patterns)
        else:
            rel = Compiler(QuadGraph(fresh)).triples([patterns[at]])
            whole, rest = Compiler(QuadGraph(quads)), patterns[:at] + patterns[at + 1 :]
            while rest:  # what shares a variable comes first, so nothing is paired in full that is bound later
                rest.sort(key=lambda x: not any(isinstance(t, Var) and t.name in rel.names for t in (x.s, x.p, x.o)))
                rel = whole.join(rel, whole.triples([rest.pop(0)]))
        rows = []
        for c in self.conclusions:
            s, p, o = (term(x) for x in c)
            node = lambda x: rel.value(x.name).v if isinstance(x, Var) else F.lit(x)
            if isinstance(o, Var):
                v = rel.value(o.name)
                obj = (v.v, v.k, v.d, v.l)
            elif isinstance(o, Literal):
                obj = (F.lit(o.value), F.lit("literal"), F.lit(o.datatype), F.lit(o.language))
            else:
                obj = (F.lit(o), F.lit("iri"), F.lit(""), F.lit(""))
            rows.append(F.struct(node(s).alias("s"), node(p).alias("p"), *(x.alias(n) for x, n in zip(obj, COLUMNS[2:], strict=True))))
        return rel.df.select(F.explode(F.array(*rows)).alias("t")).select("t.*").distinct()


@dataclass
class ActionRule:
    """Conditions are triples as in an InferenceRule; each solution gives each action, a dictionary of action
    columns in which `?x` stands for the text of a variable (null if no condition binds it) and `details` may
    be a dictionary of such."""

    name: str
    conditions: list[tuple]
    templates: list[dict]
    priority: int = 0

    def apply(self, quads: DataFrame) -> RuleResult:
        rel = Compiler(QuadGraph(quads)).triples([Pattern(*(term(x) for x in c)) for c in self.conditions])

        def shown(x: object) -> Column:
            if isinstance(x, str) and x.startswith("?"):
                return rel.value(x[1:]).v if x[1:] in rel.names else F.lit(None).cast("string")
            return F.lit(x)

        def column(x: object) -> Column:
            return F.to_json(F.struct(*(shown(v).alias(k) for k, v in x.items()))) if isinstance(x, dict) else shown(x)

        return RuleResult(actions=reduce(DataFrame.unionByName, [actions(rel.df, **{k: column(v) for k, v in t.items()}) for t in self.templates]))


#: Rounds of a fixpoint after which what they found is written as one table.
MERGE = 1
SECURITY = "https://w3id.org/security#"


def lateral_movement_rule() -> ActionRule:
    """Two sessions of a user with their addresses; a session pairs with itself too, as no condition forbids it."""
    said = {"action_type": "alert", "severity": "medium", "message": "Potential lateral movement detected", "details": {"user": "?user", "from_ip": "?ip1", "to_ip": "?ip2"}}
    sessions = [("?user", SECURITY + "hasSession", "?session1"), ("?user", SECURITY + "hasSession", "?session2")]
    return ActionRule("lateral_movement_detection", [*sessions, ("?session1", SECURITY + "sourceIp", "?ip1"), ("?session2", SECURITY + "sourceIp", "?ip2")], [said])


def privilege_escalation_rule() -> ActionRule:
    """A process of an administrator: isolate, revoke, alert."""
    conditions = [("?process", TYPE, SECURITY + "ProcessExecution"), ("?process", SECURITY + "user", "?user"), ("?user", SECURITY + "privilegeLevel", Literal("admin")), ("?process", SECURITY + "commandLine", "?command")]
    templates = [
        {"action_type": "isolate_host", "host_ip": "?host_ip", "reason": "Privileged user executing dangerous commands"},
        {"action_type": "revoke_privileges", "user": "?user", "privilege": "admin", "reason": "Dangerous command execution detected"},
        {"action_type": "alert", "severity": "critical", "message": "Privilege escalation alert", "details": {"user": "?user", "process": "?process", "command": "?command"}},
    ]
    return ActionRule("privilege_escalation_detection", conditions, templates)


def fixpoint(quads: DataFrame, rules: list[InferenceRule], rounds: int = 10_000) -> DataFrame:
    """The triples that the rules add to quads, to their fixpoint.

    From the second round on a rule is applied only where one of its conditions meets a triple of the last
    round: once for each condition, which reads those triples alone. Each round saves what it has found.
    """
    base = saved(as_quads(quads).select(*COLUMNS).distinct(), "facts")
    fresh = saved(reduce(DataFrame.unionByName, [r.infer(base) for r in rules]).distinct().join(base, list(COLUMNS), "left_anti"), "rules")
    found = [fresh]
    for _ in range(rounds):
        if not counted(fresh):
            discard(fresh, base)
            return reduce(DataFrame.unionByName, found[:-1]) if found[:-1] else quads.sparkSession.createDataFrame([], TRIPLE_DDL)
        known = reduce(DataFrame.unionByName, found, base)
        new = reduce(DataFrame.unionByName, [r.infer(known, fresh, i) for r in rules for i in range(len(r.conditions))]).distinct()
        fresh = saved(new.join(known, list(COLUMNS), "left_anti"), "rules")
        found.append(fresh)
        if len(found) > MERGE:
            merged = saved(reduce(DataFrame.unionByName, found[:-1]), "rules")
            discard(*found[:-1])
            found = [merged, fresh]
    raise FixpointError(f"rules did not settle in {rounds} rounds")


# Policies.
class PolicyError(ValueError):
    pass


@dataclass
class Policy:
    """A JSON policy. Conditions of a rule hold together; each is existence in the data or a comparison of values."""

    spec: dict
    variables: dict[str, object] = field(default_factory=dict)

    @classmethod
    def load(cls, text: str, **variables: object) -> Policy:
        spec = json.loads(text)
        for key in ("name", "rules"):
            if key not in spec:
                raise PolicyError(f"a policy has a {key}")
        return cls(spec, variables)

    @property
    def name(self) -> str:
        return self.spec["name"]

    @property
    def priority(self) -> int:
        return self.spec.get("priority", 0)

    def value(self, e: dict) -> object:
        """A constant, or a column that is an aggregate over all quads."""
        if e["type"] == "Constant":
            return e["value"]
        if e["type"] == "Variable":
            name = str(e["value"]).lstrip("?")
            if name not in self.variables:
                raise PolicyError(f"the variable {name} has no value")
            return self.variables[name]
        if e["type"] == "TripleValue":  # the smallest, if there are several
            own = e.get("value", e.get("config", e))
            return F.min(F.when((F.col("s") == own["subject"]) & (F.col("p") == own["predicate"]), F.col("o")))
        raise PolicyError(f"value of type {e['type']} is not supported")

    def holds(self, c: dict) -> Column:
        """A condition as an aggregate over all quads, or as a constant."""
        kind, config = c["type"], c.get("config", {})
        wild = lambda x: isinstance(x, str) and x.startswith("?")
        if kind in ("TripleExists", "TripleNotExists"):
            tests = [F.col("p") == config["predicate"], *(F.col(k) == config[n] for k, n in (("s", "subject"), ("o", "object")) if not wild(config[n]))]
            there = F.coalesce(F.bool_or(reduce(lambda a, b: a & b, tests)), F.lit(False))
            return there if kind == "TripleExists" else ~there
        if kind == "VariableBinding":
            name = config["variable"].lstrip("?")
            return F.lit(name in self.variables and str(self.variables[name]) == str(config["value"]))
        if kind == "NumericComparison":
            left, right = self.value(config["left"]), self.value(config["right"])
            if isinstance(left, Column) or isinstance(right, Column):
                return self.compared_columns(left, config["operator"], right)
            return F.lit(self.compared(left, config["operator"], right))
        if kind in ("And", "Or"):
            parts = [self.holds(x) for x in (config if isinstance(config, list) else config["conditions"])]
            return reduce(lambda a, b: a & b if kind == "And" else a | b, parts)
        if kind == "Not":
            return ~self.holds(config.get("condition", config))
        raise PolicyError(f"condition of type {kind} is not supported")

    @staticmethod
    def compared(left: object, op: str, right: object) -> bool:
        def number(x: object) -> float:
            try:
                return float(x)
            except (TypeError, ValueError):
                return 0.0

        a, b = number(left), number(right)
        near = abs(a - b) < 2.220446049250313e-16  # the spacing of doubles at one
        found = {"Equal": near, "NotEqual": not near, "GreaterThan": a > b, "LessThan": a < b, "GreaterThanOrEqual": a >= b, "LessThanOrEqual": a <= b, "Contains": str(right) in str(left), "NotContains": str(right) not in str(left)}
        if op not in found:
            raise PolicyError(f"operator {op} is not supported")
        return found[op]

    @staticmethod
    def compared_columns(left: object, op: str, right: object) -> Column:
        """The same of columns; a value that is not there makes no comparison hold."""
        text = [x if isinstance(x, Column) else F.lit(str(x)) for x in (left, right)]
        a, b = (x.try_cast("double") for x in text)
        near = F.abs(a - b) < 2.220446049250313e-16
        found = {"Equal": near, "NotEqual": ~near, "GreaterThan": a > b, "LessThan": a < b, "GreaterThanOrEqual": a >= b, "LessThanOrEqual": a <= b, "Contains": F.contains(*text), "NotContains": ~F.contains(*text)}
        if op not in found:
            raise PolicyError(f"operator {op} is not supported")
        return F.coalesce(found[op], F.lit(False))

    @staticmethod
    def object_of(text: str) -> tuple[Column, Column, Column]:
        """Kind, datatype and language of an object given as text: an IRI has a scheme and no blank, a blank node begins with _:."""
        kind = "bnode" if text.startswith("_:") else "iri" if re.fullmatch(r"[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]+", text) else "literal"
        return F.lit(kind), F.lit(""), F.lit("")

    def apply(self, quads: DataFrame) -> RuleResult:
        """One pass over the quads decides all rules; what a rule emits is gated by its flag."""
        rules = self.spec["rules"]
        if not rules:
            return RuleResult()
        flags = [reduce(lambda a, b: a & b, (self.holds(c) for c in r.get("conditions", [])), F.lit(True)) for r in rules]
        judged = as_quads(quads).agg(F.count("*").alias("_rows"), *(f.alias(f"_r{i}") for i, f in enumerate(flags)))
        out: dict[str, list[DataFrame]] = {"add": [], "remove": [], "actions": [], "violations": []}
        for i, r in enumerate(rules):
            on = judged.where(F.col(f"_r{i}"))
            severity = r.get("severity", "Medium").lower()
            for a in r.get("actions", []):
                kind, config = a["type"], a.get("config", {})
                if kind in ("AddTriple", "RemoveTriple"):
                    o = config["object"]
                    row = on.select(F.lit(config["subject"]).alias("s"), F.lit(config["predicate"]).alias("p"), F.lit(str(o)).alias("o"), *(c.alias(n) for c, n in zip(self.object_of(str(o)), COLUMNS[3:], strict=True)))
                    out["add" if kind == "AddTriple" else "remove"].append(row)
                elif kind == "SecurityAction":
                    out["actions"].append(self.security_action(on, r, severity, config))
                elif kind == "ReportViolation":
                    null = F.lit(None).cast("string")
                    out["violations"].append(on.select(F.lit(config.get("level", "Error")).alias("level"), F.lit(config["message"]).alias("message"), null.alias("s"), null.alias("p"), null.alias("o"), F.lit(r["id"]).alias("rule_name"), F.lit(json.dumps(config.get("context", {}))).alias("context")))
                else:
                    raise PolicyError(f"action of type {kind} is not supported")
        made = {k: reduce(DataFrame.unionByName, v) if v else None for k, v in out.items()}
        return RuleResult(**made)

    @staticmethod
    def security_action(on: DataFrame, rule: dict, severity: str, config: dict) -> DataFrame:
        """Every kind becomes an alert, with its own severity, words and details."""
        kind, said, details = config["action_type"], config["message"], config.get("details", {})
        reason = {"reason": f"Policy violation: {rule['name']}", "original_details": details}
        form = {
            "Alert": (severity, said, details),
            "Block": ("high", f"Block action required: {said}", {"action_type": "block", **reason}),
            "Log": ("info", f"Log: {said}", {"action_type": "log", "level": severity, "original_details": details}),
            "Quarantine": ("critical", f"Quarantine required: {said}", {"action_type": "quarantine", **reason}),
            "Notify": (severity, f"Notification: {said}", {"action_type": "notify", "recipients": [said], "priority": severity, "original_details": details}),
        }
        if kind not in form:
            raise PolicyError(f"security action {kind} is not supported")
        level, message, extra = form[kind]
        return actions(on, action_type="alert", severity=level, message=message, details=json.dumps(extra))


# The engine.
@dataclass
class Options:
    reasoning: bool = True
    rules: bool = True
    validation: bool = True
    materialize: bool = True


@dataclass
class EngineResult:
    inferred: DataFrame
    quads: DataFrame
    actions: DataFrame
    violations: DataFrame

    def statistics(self) -> DataFrame:
        one = lambda df, name: df.agg(F.count("*").alias(name))
        return one(self.inferred, "inferred").crossJoin(one(self.actions, "actions")).crossJoin(one(self.violations, "violations"))


def process(quads: DataFrame, registry: Registry, options: Options | None = None) -> EngineResult:
    """RDFS closure, rules, validation. With materialize rules see what was inferred, and the result has the
    triples that rules add and not those they remove."""
    options = options or Options()
    base = saved(as_quads(quads), "graph")  # each part below reads it, so what it takes to make it is done once
    spark = quads.sparkSession
    fresh = saved(entailed(base, asserted=False) if options.reasoning else spark.createDataFrame([], TRIPLE_DDL), "inferred")
    if counted(fresh):  # only triples of its predicates can be in both, and the size of the graph's files says little
        inferred, predicates = fresh, saved(fresh.select("p").distinct(), "predicates")
        known = base.select(*COLUMNS).join(small(predicates), "p", "left_semi")
        fresh = saved(inferred.join(known.hint("merge"), list(COLUMNS), "left_anti"), "inferred")
        discard(inferred, predicates)
    if registry.inferences:
        known = base.select(*COLUMNS).unionByName(fresh)
        fresh = fresh.unionByName(fixpoint(known, registry.inferences))
    seen = base.unionByName(as_quads(fresh).withColumn("graph_kind", F.lit("inferred"))) if options.materialize else base
    result = registry.apply_all(seen) if options.rules else Registry().apply_all(seen)
    after = seen.unionByName(as_quads(result.add)).join(result.remove.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*seen.columns)
    violations = result.violations.unionByName(registry.validate_all(after)) if options.validation else result.violations
    return EngineResult(fresh, after, result.actions, violations)


def process_each(quads: DataFrame, registries: list[Registry], options: Options | None = None) -> list[EngineResult]:
    """Independent engines over the same quads."""
    return [process(quads, r, options) for r in registries]


# Staged pipelines.
@dataclass
class Stage:
    """run(quads) gives the next quads. condition: min_triples or max_triples with a number, has_violations
    with a function to violations, or any function of quads to bool. Stages name what follows."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    condition: tuple[str, object] | None = None
    on_success: str | None = None
    on_failure: str | None = None


def run_pipeline(quads: DataFrame, stages: list[Stage], steps: int = 1000) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """The quads after the last stage, and the history (stage, ran). A stage whose condition fails is skipped."""
    by = {s.name: i for i, s in enumerate(stages)}
    history, at = [], 0
    for _ in range(steps):
        if at >= len(stages):
            return quads, history
        stage = stages[at]
        ok = True
        if stage.condition:
            kind, arg = stage.condition
            if kind in ("min_triples", "max_triples"):
                n = quads.limit(int(arg) + 1).count()
                ok = n >= arg if kind == "min_triples" else n <= arg
            elif kind == "has_violations":
                ok = not arg(quads).isEmpty()
            else:
                ok = bool(arg(quads))
        if ok:
            quads = stage.run(quads)
        history.append((stage.name, ok))
        follow = stage.on_success if ok else stage.on_failure
        at = by[follow] if follow else at + 1
    raise FixpointError(f"the pipeline took more than {steps} steps")
