"""A quad store on Parquet: append, find, clear, statistics, audit trail.

The table is partitioned by graph kind and a hash bucket of the predicate, so a scan of one predicate
reads one bucket of each graph kind. The store is a bag: equal triples are kept.

Quads lie in the folder quads-N with the highest N that was written to its end. Clearing writes the next
one, whose mark of success puts it in the place of the last; a driver lost before leaves all as it was.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.checkpoints import delete
from kgspark.sources.mapping import QuadGraph
from kgspark.terms import PROV, QUAD_DDL, as_quads, number_of

BUCKETS = 16
AUDIT_DDL = "id string, timestamp bigint, operation string, triple string, graph string, triple_count bigint, rule string, triples_added bigint, triples_removed bigint, query_type string, result_count bigint, actor string, metadata map<string,string>"


def sensor(source: str, confidence: float | None = None):
    return provenance(kind="sensor", source=source, confidence=confidence)


def inferred(rule: str, reasoning_level: str, evidence: list[str] | None = None):
    return provenance(kind="inferred", rule=rule, reasoning_level=reasoning_level, evidence=evidence)


def imported(source_uri: str, imported_at: int):
    return provenance(kind="imported", source_uri=source_uri, imported_at=imported_at)


def provenance(**values):
    fields = [x.split(":", 1) for x in PROV[len("struct<") : -1].split(",")]
    lit = lambda v: F.array(*(F.lit(x) for x in v)) if isinstance(v, list) else F.lit(v)
    return F.struct(*(lit(values.get(n)).cast(t).alias(n) for n, t in fields))


class QuadStore:
    """quads() reads what append() wrote; every change adds a row to the audit trail."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ddl)

    def _generation(self) -> int:
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        whole = [n for n in names if n.startswith("quads-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max((int(n.removeprefix("quads-")) for n in whole), default=0)

    def _quads(self) -> DataFrame:
        return self._read(f"quads-{self._generation()}", QUAD_DDL + ", o_num double, p_bucket int")

    def quads(self) -> DataFrame:
        return self._quads().drop("p_bucket", "o_num")

    def as_graph(self) -> QuadGraph:
        """The stored quads to query; numbers are stored, so comparisons with them reach the files."""
        return QuadGraph(self._quads())

    def append(self, triples: DataFrame, graph_kind: str = "default", graph_name: str | None = None, prov=None, actor: str | None = None) -> None:
        """Insert all rows with one graph and provenance."""
        rows = as_quads(triples).withColumns({"graph_kind": F.lit(graph_kind), "graph_name": F.lit(graph_name).cast("string"), "asserted_at": F.current_timestamp()})
        if prov is not None:
            rows = rows.withColumn("prov", prov)
        own = rows.withColumn("o_num", number_of(F.col("o"), F.col("o_kind"), F.col("o_dt"))).withColumn("p_bucket", F.pmod(F.hash("p"), F.lit(BUCKETS)))
        own.write.mode("append").partitionBy("graph_kind", "p_bucket").parquet(f"{self.path}/quads-{self._generation()}")
        self.log("insert", graph=self.graph_label(graph_kind, graph_name), actor=actor)

    @staticmethod
    def graph_label(kind: str, name: str | None) -> str:
        return kind if name is None else f"{kind}:{name}"

    def log(self, operation: str, **values) -> None:
        row = {"id": str(uuid.uuid4()), "timestamp": time.time_ns() // 1_000_000, "operation": operation, **values}
        names = [x.strip().split(" ")[0] for x in AUDIT_DDL.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], AUDIT_DDL).coalesce(1).write.mode("append").parquet(f"{self.path}/audit")

    def find(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Quads with these texts; a given predicate prunes to its bucket."""
        out = self._quads()
        if p is not None:
            out = out.where(F.col("p_bucket") == F.pmod(F.hash(F.lit(p)), F.lit(BUCKETS)))
        for name, value in (("s", s), ("p", p), ("o", o)):
            if value is not None:
                out = out.where(F.col(name) == value)
        return out.drop("p_bucket", "o_num")

    def graph(self, kind: str, name: str | None = None) -> DataFrame:
        return self.quads().where((F.col("graph_kind") == kind) & F.col("graph_name").eqNullSafe(F.lit(name)))

    def graphs(self) -> DataFrame:
        return self.quads().select("graph_kind", "graph_name").distinct()

    def clear(self, kind: str | None = None, name: str | None = None) -> None:
        """Remove one graph, or all. What stays is written anew beside the old folder, which then goes."""
        keep = self._quads().where(F.lit(False)) if kind is None else self._quads().where(~((F.col("graph_kind") == kind) & F.col("graph_name").eqNullSafe(F.lit(name))))
        now = self._generation()
        keep.withColumn("p_bucket", F.pmod(F.hash("p"), F.lit(BUCKETS))).write.mode("overwrite").partitionBy("graph_kind", "p_bucket").parquet(f"{self.path}/quads-{now + 1}")
        delete(self.spark, f"{self.path}/quads-{now}")
        self.log("clear", graph=None if kind is None else self.graph_label(kind, name))

    def statistics(self) -> DataFrame:
        return statistics(self.quads()).crossJoin(self.audit().agg(F.count("*").alias("audit_entries")))

    def audit(self, last: int | None = None) -> DataFrame:
        """The trail, or its last rows."""
        trail = self._read("audit", AUDIT_DDL)
        return trail if last is None else trail.orderBy(F.desc("timestamp"), F.desc("id")).limit(last)


def statistics(quads: DataFrame) -> DataFrame:
    """Counts of triples, graphs and distinct subjects, predicates and objects."""
    graph = F.concat_ws("\x01", "graph_kind", F.coalesce("graph_name", F.lit("")))
    return quads.agg(F.count("*").alias("triples"), F.count_distinct(graph).alias("graphs"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct("o").alias("objects"))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key, the latest: an upsert by reading."""
    own = Window.partitionBy(key).orderBy(F.col(at).desc())
    return rows.withColumn("_rank", F.row_number().over(own)).where("_rank = 1").drop("_rank")
