"""N-Triples and JSON-LD, in and out, without user functions where a line or a node is enough."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.checkpoints import discard, saved
from kgspark.terms import BOOLEAN, DOUBLE, INTEGER, LANG_STRING, RDF, RDFS, STRING, TYPE, as_quads, node_kind

#: One statement of a line: subject, predicate, object and, in N-Quads, a graph.
LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s.]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z][A-Za-z0-9\-]*)?)\s*(<[^>]*>)?\s*\.\s*(?:#.*)?$'
LITERAL = r'(?s)^"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@(.+))?$'


def unescaped(c: Column) -> Column:
    """The text of an escaped literal; \\uXXXX and \\UXXXXXXXX too."""
    out = F.regexp_replace(c, r"\\\\", "\x00")
    for mark, char in (("n", "\n"), ("r", "\r"), ("t", "\t"), ('"', '"'), ("b", "\b"), ("f", "\f"), ("'", "'")):
        out = F.replace(out, F.lit("\\" + mark), F.lit(char))
    points = F.filter(F.array_distinct(F.regexp_extract_all(out, F.lit(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"), 1)), lambda x: x != "")
    shown = lambda x: F.decode(F.unhex(F.lpad(F.substr(x, F.lit(2)), 8, "0")), "UTF-32")
    out = F.when(F.size(points) > 0, F.aggregate(points, out, lambda acc, x: F.replace(acc, F.concat(F.lit("\\"), x), shown(x)))).otherwise(out)
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def escaped(c: Column) -> Column:
    for char, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(mark))
    return c


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Quads of N-Triples or N-Quads lines. Blank and comment lines are skipped; another line fails the job."""
    line = F.col(column)
    skipped = line.rlike(r"^\s*(#.*)?$")
    known = lines.where(~skipped)
    part = lambda i: F.regexp_extract(line, LINE, i)
    ok = line.rlike(LINE)
    raw = known.select(F.when(skipped, F.lit(None).cast("string")).when(ok, part(1)).otherwise(F.raise_error(F.concat(F.lit("no N-Triples: "), line))).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("g"))
    bare = lambda c: F.when(c.startswith("<"), F.expr(f"substring({'s' if c is S else 'o' if c is O else 'g'}, 2, length({'s' if c is S else 'o' if c is O else 'g'}) - 2)")).otherwise(c)
    S, O, G = F.col("s"), F.col("o"), F.col("g")  # noqa: E741, N806
    literal = O.startswith('"')
    piece = lambda i: F.regexp_extract(O, LITERAL, i)
    return as_quads(
        raw.select(
            bare(S).alias("s"), "p", F.when(literal, unescaped(piece(1))).otherwise(bare(O)).alias("o"), F.when(literal, F.lit("literal")).otherwise(node_kind(O)).alias("o_kind"),
            F.when(literal & (piece(3) != ""), F.lit(LANG_STRING)).when(literal & (piece(2) != ""), piece(2)).when(literal, F.lit(STRING)).otherwise(F.lit("")).alias("o_dt"), F.when(literal, F.lower(piece(3))).otherwise(F.lit("")).alias("o_lang"),
            F.when(G != "", F.lit("named")).otherwise(F.lit("default")).alias("graph_kind"), F.when(G != "", bare(G)).alias("graph_name"),
        )
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def to_ntriples(quads: DataFrame) -> DataFrame:
    """A column `value` with a line for each quad; quads of named graphs become N-Quads."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    tail = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dt").isin("", STRING), F.lit("")).otherwise(F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">")))
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), tail)).otherwise(node("o"))
    graph = F.when(F.col("graph_name").isNotNull(), F.concat(F.lit(" <"), F.col("graph_name"), F.lit(">"))).otherwise(F.lit(""))
    return as_quads(quads).select(F.concat(node("s"), F.lit(" <"), F.col("p"), F.lit("> "), o, graph, F.lit(" .")).alias("value"))


def parse_jsonld(documents: DataFrame, column: str = "value", depth: int = 3) -> DataFrame:
    """Quads of JSON-LD documents, one a row: @graph or a single node, @id, @type, scalars, arrays, {"@id"},
    {"@value", "@type", "@language"} and nested nodes; terms by @vocab and prefixes of @context.

    One plan expands `depth` levels; nodes below are written and expanded by the next plan until none are
    left. A stream, which has one plan only, fails on nodes with contents below `depth`.
    Nodes without @id become blank nodes named by a hash of their document and place.
    """
    doc = F.col(column)
    context = F.from_json(F.get_json_object(doc, "$.@context"), "map<string,string>")
    context = F.coalesce(context, F.create_map().cast("map<string,string>"))
    listed = F.get_json_object(doc, "$.@graph")
    nodes = F.when(listed.startswith("["), F.from_json(listed, "array<string>")).when(listed.isNotNull(), F.array(listed)).otherwise(F.array(doc))
    mark = lambda *c: F.concat(F.lit("_:j"), F.substr(F.sha2(F.concat_ws("\x01", *c), 256), F.lit(1), F.lit(16)))
    each = documents.select(context.alias("context"), doc.alias("doc"), F.posexplode(nodes).alias("at", "node"))

    def expanded(term: Column) -> Column:
        prefix = F.substring_index(term, ":", 1)
        ctx = F.col("context")
        return (
            F.when(F.try_element_at(ctx, term).isNotNull(), F.try_element_at(ctx, term))
            .when(term.contains(":") & F.try_element_at(ctx, prefix).isNotNull(), F.concat(F.try_element_at(ctx, prefix), F.substr(term, F.length(prefix) + 2)))
            .when(term.contains(":"), term)
            .otherwise(F.concat(F.coalesce(F.try_element_at(ctx, F.lit("@vocab")), F.lit("")), term))
        )

    out = None
    level = each.select("context", "node", F.coalesce(expanded_id(F.get_json_object("node", "$.@id"), expanded), mark(F.col("doc"), F.col("at").cast("string"))).alias("s"))
    for turn in count(1):
        fields = level.select("context", "s", F.explode(F.from_json("node", "map<string,string>")).alias("key", "raw")).where(~F.col("key").isin("@id", "@context", "@graph"))
        many = F.when(F.col("raw").startswith("[") & F.from_json("raw", "array<string>").isNotNull(), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
        values = fields.select("context", "s", "key", F.posexplode(many).alias("i", "v")).where("v is not null")
        inner = F.col("v").startswith("{") & F.from_json("v", "map<string,string>").isNotNull()
        given, value = F.get_json_object("v", "$.@id"), F.get_json_object("v", "$.@value")
        lang, dt = F.get_json_object("v", "$.@language"), F.get_json_object("v", "$.@type")
        is_type = F.col("key") == "@type"
        nested = inner & value.isNull()
        plain_dt = F.when(F.col("v").isin("true", "false"), BOOLEAN).when(F.col("v").rlike(r"^-?\d+$"), INTEGER).when(F.col("v").rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), DOUBLE).otherwise(STRING)
        o = F.when(is_type, expanded(F.col("v"))).when(nested, F.coalesce(expanded_id(given, expanded), mark(F.col("s"), F.col("key"), F.col("i").cast("string"), F.col("v")))).when(inner, value).otherwise(F.col("v"))
        if last := documents.isStreaming and turn == depth:
            lost = nested & F.exists(F.map_keys(F.from_json("v", "map<string,string>")), lambda x: ~x.isin("@id", "@context", "@graph"))
            o = F.when(lost, F.raise_error(F.lit(f"JSON-LD nodes are nested below {depth} levels"))).otherwise(o)
        o_dt = F.when(is_type | nested, F.lit("")).when(inner & lang.isNotNull(), F.lit(LANG_STRING)).when(inner, F.coalesce(expanded(dt), F.lit(STRING))).otherwise(plain_dt)
        rows = values.select(
            "context", "s", "v", nested.alias("nested"), F.when(is_type, F.lit(TYPE)).otherwise(expanded(F.col("key"))).alias("p"), o.alias("o"), o_dt.alias("o_dt"), F.when(inner & lang.isNotNull(), F.lower(lang)).otherwise(F.lit("")).alias("o_lang"), (is_type | nested).alias("is_node")
        )
        quads = rows.select("s", "p", "o", F.when(F.col("is_node"), node_kind(F.col("o"))).otherwise(F.lit("literal")).alias("o_kind"), "o_dt", "o_lang")
        out = quads if out is None else out.unionByName(quads)
        if last:
            break
        level = rows.where("nested").select("context", F.col("v").alias("node"), F.col("o").alias("s"))
        if turn % depth == 0:
            level = saved(level, "jsonld")
            if level.isEmpty():
                discard(level)
                break
    return as_quads(out)


def expanded_id(value: Column, expanded) -> Column:
    return F.when(value.isNotNull(), F.when(value.startswith("_:") | value.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), value).when(value.contains(":"), expanded(value)).otherwise(value))


def to_jsonld(quads: DataFrame) -> DataFrame:
    """A column `node` with a JSON-LD node for each subject, its predicates as arrays."""
    q = as_quads(quads)
    value = F.when(F.col("o_kind") != "literal", F.to_json(F.struct(F.col("o").alias("@id")))).when(F.col("o_lang") != "", F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_lang").alias("@language")))).otherwise(F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_dt").alias("@type"))))
    lists = q.groupBy("s", "p").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_set(value)), ","), F.lit("]")).alias("os"))
    nodes = lists.groupBy("s").agg(F.collect_list(F.struct("p", "os")).alias("own"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    fields = F.transform(F.array_sort("own"), lambda x: F.concat(quoted(x["p"]), F.lit(":"), x["os"]))
    return nodes.select("s", F.concat(F.lit('{"@id":'), quoted(F.col("s")), F.lit(","), F.array_join(fields, ","), F.lit("}")).alias("node"))


JSONLD_CONTEXT = {"@vocab": "https://w3id.org/security#", "rdf": RDF, "rdfs": RDFS}
