"""Graphs to scan: quad tables, and virtual triples over relational tables.

A virtual graph is a list of branches, one for each column of a table. A scan picks the branches that
its constants can meet while the plan is built, and turns a constant subject or object into a filter on
the table's own column, so that Parquet gets it as a pushed filter and reads two columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.terms import BOOLEAN, DATETIME, DOUBLE, INTEGER, NUMERIC, SCAN_COLUMNS, STRING, TERM_COLUMNS, TP, TYPE, as_quads, number_of


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = STRING
    language: str = ""


Constant = str | Literal | None


class Graph:
    """What a pattern scans."""

    spark: SparkSession

    def scan(self, s: Constant = None, p: Constant = None, o: Constant = None) -> DataFrame:
        """The quads (SCAN_COLUMNS) that have these terms."""
        raise NotImplementedError

    def size_hint(self, p: Constant) -> float:
        """A guess of how many quads have this predicate, relative to others."""
        return 1.0


def object_is(o: Constant) -> Column:
    if isinstance(o, Literal):
        same = (F.col("o") == o.value) & (F.col("o_kind") == "literal")
        return same & (F.col("o_lang") == o.language) if o.language else same & (F.col("o_dt") == o.datatype) & (F.col("o_lang") == "")
    return (F.col("o") == o) & (F.col("o_kind") != "literal")


class QuadGraph(Graph):
    """A table of quads. With a column o_num (as stored quads have it) numbers are read and filtered as such, else worked out from the text."""

    def __init__(self, quads: DataFrame, predicate_counts: dict[str, int] | None = None) -> None:
        own = as_quads(quads)
        number = F.col("o_num") if "o_num" in quads.columns else number_of(F.col("o"), F.col("o_kind"), F.col("o_dt")).alias("o_num")
        self.quads = (quads if "o_num" in quads.columns else own).select(*TERM_COLUMNS, number)
        self.spark, self.counts = quads.sparkSession, predicate_counts or {}

    def scan(self, s: Constant = None, p: Constant = None, o: Constant = None) -> DataFrame:
        out = self.quads
        for name, term in (("s", s), ("p", p)):
            if isinstance(term, Literal):
                return out.limit(0)
            if term is not None:
                out = out.where(F.col(name) == term)
        return out if o is None else out.where(object_is(o))

    def size_hint(self, p: Constant) -> float:
        return float(self.counts.get(p, 1)) if isinstance(p, str) else float(sum(self.counts.values()) or 10)


#: The datatype of the literals of each column type, fixed values.
DATATYPES = {"bigint": INTEGER, "int": INTEGER, "double": DOUBLE, "float": DOUBLE, "string": STRING, "boolean": BOOLEAN, "timestamp": DATETIME, "timestamp_ntz": DATETIME, "date": DATETIME}


@dataclass
class Branch:
    """Triples (prefix + key, predicate, object) for the rows of a table whose object is not null."""

    table: DataFrame
    prefix: str
    key: Column
    predicate: str
    value: Column
    kind: str = "literal"
    datatype: str = STRING
    value_prefix: str = ""
    key_type: str = "bigint"
    value_type: str = "string"
    rows: float = 1.0
    unique: bool = False  # whether no two rows have one key

    def having(self, table: DataFrame, o: Constant) -> DataFrame | None:
        """The rows of the table that have the object, or any; None if the branch has no such objects."""
        if isinstance(o, Literal):
            if self.kind != "literal" or o.language or o.datatype != self.datatype:
                return None
            table = table.where(self.value == F.lit(o.value).try_cast(self.value_type)) if self.value_type in ("string", "bigint", "int") else table.where(self.value.cast("string") == o.value)
        elif o is not None:
            if self.kind == "literal" or not o.startswith(self.value_prefix):
                return None
            rest = o[len(self.value_prefix) :]
            table = table.where(self.value == F.lit(rest).try_cast(self.value_type))
        return table.where(self.value.isNotNull())

    @property
    def subject(self) -> Column:
        return F.concat(F.lit(self.prefix), self.key.cast("string"))

    @property
    def term(self) -> tuple[Column, Column, Column, Column, Column]:
        """Text, kind, datatype, language and number of the object."""
        text = self.value.cast("string")
        text = F.concat(F.lit(self.value_prefix), text) if self.value_prefix else text
        number = (self.value if self.kind == "literal" and self.datatype in NUMERIC else F.lit(None)).cast("double")
        return text, F.lit(self.kind), F.lit(self.datatype if self.kind == "literal" else ""), F.lit(""), number

    def quads(self, s: Constant, o: Constant) -> DataFrame | None:
        table = self.table
        if s is not None:
            if isinstance(s, Literal) or not s.startswith(self.prefix):
                return None
            table = table.where(self.key == F.lit(s[len(self.prefix) :]).try_cast(self.key_type))
        table = self.having(table, o)
        if table is None:
            return None
        names = ("o", "o_kind", "o_dt", "o_lang", "o_num")
        o_, kind, dt, lang, num = (c.alias(n) for c, n in zip(self.term, names, strict=True))
        return table.select(self.subject.alias("s"), F.lit(self.predicate).alias("p"), o_, kind, dt, lang, F.lit("default").alias("graph_kind"), F.lit(None).cast("string").alias("graph_name"), num)


@dataclass
class VirtualGraph(Graph):
    spark: SparkSession
    branches: list[Branch] = field(default_factory=list)

    def scan(self, s: Constant = None, p: Constant = None, o: Constant = None) -> DataFrame:
        found = [q for b in self.branches if p is None or b.predicate == p for q in [b.quads(s, o)] if q is not None]
        if not found:
            return self.spark.createDataFrame([], ", ".join(f"{c} {'double' if c == 'o_num' else 'string'}" for c in SCAN_COLUMNS))
        return reduce(DataFrame.unionByName, found)

    def size_hint(self, p: Constant) -> float:
        return sum(b.rows for b in self.branches if p is None or b.predicate == p)

    def star(self, wanted: list[tuple[str, Constant]]) -> DataFrame | None:
        """s and the objects (o0, o0_kind, o0_dt, o0_lang, o0_num, o1 ...) of the subjects that have all these predicates,
        by one scan of each table; None where a table has no unique key, or two columns of one predicate."""
        found = []
        for prefix in dict.fromkeys(b.prefix for b in self.branches):
            own = [[b for b in self.branches if b.prefix == prefix and b.predicate == p] for p, _ in wanted]
            if not all(own):
                continue
            if any(len(x) > 1 or not x[0].unique or x[0].table is not own[0][0].table for x in own):
                return None
            table: DataFrame | None = own[0][0].table
            for (b,), (_, o) in zip(own, wanted, strict=True):
                table = table if table is None else b.having(table, o)
            if table is not None:
                terms = [c.alias(f"o{i}{n}") for i, (b,) in enumerate(own) for c, n in zip(b.term, ("", "_kind", "_dt", "_lang", "_num"), strict=True)]
                found.append(table.select(own[0][0].subject.alias("s"), *terms))
        return reduce(DataFrame.unionByName, found) if found else None

    def add_table(self, df: DataFrame, name: str, key: str, links: dict[str, str] | None = None, rows: float = 1.0, skip: tuple[str, ...] = (), unique: bool = True) -> None:
        """A branch for each column and one for the type `tp:<Name>`; links name the table a column refers to."""
        kinds = dict(df.dtypes)
        base = dict(table=df, prefix=f"urn:{name}:", key=F.col(key), key_type=kinds[key], rows=rows, unique=unique)
        self.branches.append(Branch(**base, predicate=TYPE, value=F.lit(TP + name.capitalize()), kind="iri"))
        for c, t in df.dtypes:
            if c in skip or t not in DATATYPES:
                continue
            short = (links or {}).get(c)
            if short:
                self.branches.append(Branch(**base, predicate=TP + short, value=F.col(c), kind="iri", value_prefix=f"urn:{short}:", value_type=t))
            else:
                self.branches.append(Branch(**base, predicate=TP + c, value=F.col(c), datatype=DATATYPES[t], value_type=t))


def tpch_graph(spark: SparkSession, sf_dir: str) -> VirtualGraph:
    """The relational tables as triples urn:<table>:<key> tp:<column> <value>; foreign keys are links."""
    graph = VirtualGraph(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    graph.add_table(read("region"), "region", "r_regionkey", rows=0.001)
    graph.add_table(read("nation"), "nation", "n_nationkey", {"n_regionkey": "region"}, rows=0.002)
    graph.add_table(read("customer"), "customer", "c_custkey", {"c_nationkey": "nation"}, rows=0.15)
    graph.add_table(read("supplier"), "supplier", "s_suppkey", {"s_nationkey": "nation"}, rows=0.01)
    graph.add_table(read("part"), "part", "p_partkey", rows=0.2)
    graph.add_table(read("orders"), "orders", "o_orderkey", {"o_custkey": "customer"}, rows=1.5)
    lines = read("lineitem").withColumn("l_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))  # no shorter key is unique
    graph.add_table(lines, "lineitem", "l_key", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, rows=6.0, skip=("l_key",), unique=False)
    return graph
