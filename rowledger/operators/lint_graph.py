"""Lint of what declarations say about each other: visibility along nested types, recursion and depth of structs, expressions,
weights, and what a host has to register.

types (type, targets, validators, live): declared tables and structs; live ones are where nesting begins.
fields (type, field_id, name, kind, shape, message, oneof, targets, expand, ref_table, symbols_type, result, weight_field,
condition_field, codec): message is the type of a struct, of the elements of a list of structs, or of a map's values; shape as
in schema.lint_declarations; targets null: those of the parent. A frame may lack what its rule does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rowledger.operators import graph

# Scalar kinds that a weight may have, and results of expressions.
NUMERIC = ("int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "float", "double")
RESULTS = ("float", "int", "bool")


def inherited_targets(types: DataFrame, fields: DataFrame) -> DataFrame:
    """(type, targets): every set of targets under which a type's fields are reached from a live type.

    A fixpoint over pairs of a type and a set: there are finitely many, however types nest, so recursive ones end as well.
    Each round follows only the pairs that the one before it found.
    """
    named = F.array_sort(F.array_distinct("targets")).alias("targets")
    nested = fields.where("message is not null").select(F.col("type").alias("_t"), "message", F.col("targets").alias("own"))
    seen = frontier = types.where("live").select("type", named).distinct().checkpoint()
    rounds = 0
    while True:
        step = frontier.join(nested, F.col("type") == F.col("_t")).select(F.col("message").alias("type"), F.coalesce("own", "targets").alias("targets")).select("type", named).distinct()
        met = Observation()
        frontier = step.join(seen, ["type", "targets"], "left_anti").observe(met, F.count("*").alias("n")).checkpoint()
        if not met.get["n"]:
            return seen
        rounds += 1
        seen = seen.union(frontier) if rounds % 16 else seen.union(frontier).checkpoint()


def lint_visibility(types: DataFrame, fields: DataFrame) -> DataFrame:
    """(type, field_id, rule, missing): targets of a field that its parent lacks (target.outside), and those in which the struct
    that it holds (struct.invisible) or the table that it refers to (ref.invisible) does not exist; over all ways in which
    live types reach it."""
    at = inherited_targets(types, fields).join(fields.select("type", "field_id", F.col("targets").alias("own"), "message", "ref_table"), "type")
    at = at.withColumn("shown", F.coalesce("own", "targets"))
    declared = types.select(F.col("type").alias("_t"), F.col("targets").alias("_has"))
    held = lambda c: at.join(declared, F.col(c) == F.col("_t")).select("type", "field_id", F.array_except("shown", "_has").alias("missing"))
    found = at.where("own is not null").select("type", "field_id", F.array_except("own", "targets").alias("missing")).withColumn("rule", F.lit("target.outside"))
    found = found.union(held("message").withColumn("rule", F.lit("struct.invisible"))).union(held("ref_table").withColumn("rule", F.lit("ref.invisible")))
    one = found.select("type", "field_id", "rule", F.explode("missing").alias("m")).distinct()
    return one.groupBy("type", "field_id", "rule").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("missing"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) both of whose ends lie on a common cycle: those inside a strongly connected component.

    What has no way in or no way out is trimmed; of the rest every node takes the greatest node that reaches it as its colour. A
    component has one colour, so edges between colours go at once, and with them the long ways that would be trimmed an
    end at a time; what reaches a colour's own node within the colour is one component. No set of pairs is ever made, and no table
    of a round is sent to the driver: rounds are as many as the data ask for, so that each one's few MB would add up.
    """
    spark = edges.sparkSession
    left, first = graph.written(edges.select("src", "dst").distinct())
    found = graph.written(left.where("src = dst"))[0]
    left, path = graph.written(left.where("src <> dst"))
    graph.delete(spark, first)
    n, before = left.count(), None
    while n:
        while n and n != before:  # trim
            into, out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            inner, new = graph.written(left.join(into.hint("merge"), "src", "left_semi").join(out.hint("merge"), "dst", "left_semi").select("src", "dst"))
            graph.delete(spark, path)
            left, path, before, n = inner, new, n, inner.count()
        if not n:
            break
        colours, shown = graph.written(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().select("node", F.col("node").alias("colour")))
        while True:
            told = left.join(colours.withColumnRenamed("node", "src").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("c"))
            met = Observation()
            made = colours.join(told.hint("merge"), "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") > F.col("colour")).alias("_up"))
            colours, new = graph.written(made.observe(met, F.count_if("_up").alias("n")).drop("_up"))
            graph.delete(spark, shown)
            shown = new
            if not met.get["n"]:
                break
        of = lambda c, as_: colours.select(F.col("node").alias(c), F.col("colour").alias(as_)).hint("merge")  # noqa: B023, E731
        same, within = graph.written(left.join(of("src", "_a"), "src").join(of("dst", "_b"), "dst").where("_a = _b").select("src", "dst"))
        inside = graph.reach(graph.reverse(same), colours.where("node = colour").select("node"))
        a, b = inside.withColumnRenamed("node", "src").hint("merge"), inside.withColumnRenamed("node", "dst").hint("merge")
        found = found.union(graph.written(same.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst"))[0])
        left, new = graph.written(same.join(a, "src", "left_anti").join(b, "dst", "left_anti").select("src", "dst"))
        graph.delete(spark, path, shown, within)
        path, before, n = new, None, left.count()
    return found


def lint_structs(fields: DataFrame) -> DataFrame:
    """(type, field_id, rule): fields by which a type holds itself, over any number of steps (struct.recursive), and structs in a single
    cell that need more than the two layers of a format (struct.layers): one below which there is a list of structs, a map, or
    a struct that is not flat itself."""
    links = fields.where("message is not null")
    cycles = cyclic_edges(links.select(F.col("type").alias("src"), F.col("message").alias("dst"))).select(F.col("src").alias("type"), F.col("dst").alias("message"))
    recursive = links.join(cycles, ["type", "message"], "left_semi").select("type", "field_id", F.lit("struct.recursive").alias("rule"))
    # Three levels are all that can matter, so a walk of three joins replaces any recursion.
    filled = fields.select(F.col("type").alias("message")).distinct()
    deep = F.col("shape").isin("structs", "map")
    full = fields.where("shape = 'struct'").join(filled, "message", "left_semi")
    bumpy = fields.where(deep | (F.col("shape") == "list")).select("type").union(full.select("type")).distinct().withColumnRenamed("type", "message")
    steep = fields.where(deep).select("type").union(fields.where("shape = 'struct'").join(bumpy, "message", "left_semi").select("type")).distinct().withColumnRenamed("type", "message")
    layers = fields.where("shape = 'struct' and not coalesce(expand, false)").join(steep, "message", "left_semi")
    return recursive.union(layers.select("type", "field_id", F.lit("struct.layers").alias("rule")))


def lint_expressions(fields: DataFrame, types: DataFrame) -> DataFrame:
    """(type, field_id, rule, symbol) of fields with an expression (result is not null): declared on no single string, typed by symbols
    that do not exist or are composite (each named), or with an unknown result."""
    made = fields.where("result is not null")
    none = F.lit(None).cast("string")
    known = types.select(F.col("type").alias("symbols_type"), F.lit(True).alias("_known")).distinct()
    one = made.join(known, "symbols_type", "left")
    rules = {
        "expression.shape": (F.col("shape") != "scalar") | (F.col("kind") != "string"),
        "expression.symbols": F.col("_known").isNull(),
        "expression.result": ~F.col("result").isin(*RESULTS),
    }
    found = one.select("type", "field_id", _broken(rules), none.alias("symbol"))
    composite = fields.where((F.col("shape") != "scalar") | F.col("message").isNotNull() | F.col("oneof").isNotNull()).select(F.col("type").alias("symbols_type"), F.col("name").alias("symbol"))
    bad = made.select("type", "field_id", "symbols_type").join(known.select("symbols_type"), "symbols_type", "left_semi").join(composite, "symbols_type")
    return found.union(bad.select("type", "field_id", F.lit("expression.composite"), "symbol"))


def lint_weights(fields: DataFrame) -> DataFrame:
    """(type, field_id, rule) of weighted fields (weight_field is not null): declared on no list of structs, or whose weight is no
    single number, or whose condition (null or 0: none) is neither a bool nor an expression that gives one. Weight and
    condition are numbers of fields of the elements' type."""
    made = fields.where("weight_field is not null").select("type", "field_id", "shape", "message", "weight_field", F.nullif(F.col("condition_field"), F.lit(0)).alias("condition_field"))
    weight = fields.where((F.col("shape") == "scalar") & F.col("kind").isin(*NUMERIC) & (F.col("field_id") > 0))
    holds = fields.where("result = 'bool' or (shape = 'scalar' and kind = 'bool')")
    side = lambda rows, at, flag: rows.select(F.col("type").alias("message"), F.col("field_id").alias(at), F.lit(True).alias(flag)).distinct()
    j = made.join(side(weight, "weight_field", "_w"), ["message", "weight_field"], "left").join(side(holds, "condition_field", "_c"), ["message", "condition_field"], "left")
    lists = F.coalesce((F.col("shape") == "structs") & F.col("message").isNotNull(), F.lit(False))
    rules = {
        "weighted.shape": ~lists,
        "weighted.weight": lists & F.col("_w").isNull(),
        "weighted.condition": lists & F.col("condition_field").isNotNull() & F.col("_c").isNull(),
    }
    return j.select("type", "field_id", _broken(rules))


def lint_registrations(types: DataFrame, fields: DataFrame, registered: DataFrame) -> DataFrame:
    """(type, field_id, kind, name): validators of types and codecs of fields that a host still has to register; registered (kind:
    validator or codec, name). Blank names are none."""
    wanted = types.select("type", F.lit(None).cast("long").alias("field_id"), F.lit("validator").alias("kind"), F.explode("validators").alias("name"))
    wanted = wanted.union(fields.where("codec is not null").select("type", F.col("field_id").cast("long"), F.lit("codec"), "codec"))
    return wanted.where(F.trim("name") != "").distinct().join(registered.select("kind", "name").distinct(), ["kind", "name"], "left_anti").select("type", "field_id", "kind", "name")


def _broken(rules: dict[str, Column]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items()]))).alias("rule")
