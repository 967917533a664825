"""Definitions and uses of names in trees, and the data edges between them.

A tree is read and resolved in one task (`functions/walks.py`): one pass over its nodes places them and gives the events,
one pass over the events in order of time links uses to definitions, which are kept by (scope, name). Trees in JSON need no
exchange at all; nodes in rows meet once per tree.

events: sample_id, pos (node of the identifier), t (time in evaluation order), at (node that the scopes are looked up from),
name, kind (def, use), how (declare, assign, call; null for uses), is_function (uses before it are linked to it if nothing
else defines them), quiet (a use that is neither reported nor linked to later functions), scope (of a declaration: a node,
or GLOBAL), home (innermost function, object or root), top (whether the place is on the top level).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitweave.functions.walks import GLOBAL, Placed, edges_by_source  # noqa: F401
from unitweave.operators.trees import LEVELS, NAMES, PAIRS, map_nodes, map_trees, walked

EVENTS = ["sample_id", "pos", "t", "at", "name", "kind", "how", "is_function", "quiet", "scope", "home", "top"]
_EVENTS = "t long, pos int, at long, name string, kind string, how string, is_function boolean, quiet boolean, scope int, home int, top boolean"
_LINKS = "name string, end_id int, t long, begin_id int, begin_t long, how string"
_EDGES = "src int, dst int, ord long, begin_id int, end_id int, name string"


def enclosing(points: DataFrame, intervals: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One row per point and interval that holds it, with the interval's payload and level (1 is outermost).

    points: sample_id, point, ...; intervals: sample_id, begin, end, payload; begins differ and intervals are nested or
    apart. A point at level n asks for the last interval that began at each level up to n.
    """
    names = points.columns
    inside = F.struct(*[F.col(c).alias(c) for c in payload])
    none = F.lit(None).cast(intervals.select(inside.alias("x")).schema["x"].dataType)
    nobody = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in names if c != "sample_id"]
    of = lambda df, at, side, step, held, own: df.select("sample_id", at.cast("long").alias("_at"), F.lit(side).alias("_side"), F.lit(step).alias("_step"), held.alias("_in"), *own)
    own = [F.col(c) for c in names if c != "sample_id"]
    rows = (
        of(intervals, F.col("end") + 1, 0, -1, none, nobody)
        .unionByName(of(intervals, F.col("begin"), 1, 1, inside, nobody))
        .unionByName(of(points, F.col("point"), 2, 0, none, own))
    )
    level = F.sum("_step").over(Window.partitionBy("sample_id").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    leveled = rows.withColumn("level", level).where("_side > 0 and level > 0")
    asked = leveled.withColumn("level", F.explode(F.when(F.col("_side") == 1, F.array("level")).otherwise(F.sequence(F.lit(1).cast("long"), "level"))))
    last = F.last("_in", ignorenulls=True).over(
        Window.partitionBy("sample_id", "level").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    )
    found = asked.withColumn("_in", last).where("_side = 2")
    return found.select(*names, F.col("level").cast("int").alias("level"), *[F.col(f"_in.{c}").alias(c) for c in payload])


def _over(trees: DataFrame, of, schema: str) -> DataFrame:
    """Rows of each tree, given in JSON (column tree) or as nodes."""
    if "tree" in trees.columns:
        return map_trees(trees, of, schema)
    attribute = lambda k: F.element_at("attributes", k)
    return map_nodes(trees, of, schema, {
        "name": F.col("name"), "parent_id": F.col("parent_id"), "body": F.col("body"), "ident": attribute("name"), "kind": attribute("kind"),
        "operator": attribute("operator"), "computed": F.lower(attribute("computed")).isin("true", "1"),
        "window": F.array_contains(F.map_values("attributes"), "window"),
    })


def identifier_events(trees: DataFrame) -> DataFrame:
    """Definitions and uses of names, by patterns over nodes. Here and below, trees are in JSON (sample_id, tree) or nodes.

    * Of obj.prop only obj counts; of this.x and window.x only x; of a[i] also i. What stands in an object literal inside
      a target is left out.
    * Declarators and parameters define all names of their pattern. A let or const below the top level is visible in the
      statement around it, a var in its function; on the top level both are global.
    * The left side of an assignment is defined before the right side is read; a compound one also uses it afterwards.
    * A write to a member uses the object as it was, and defines it. A call of a member does so if the object is known.
      Members by index are only used.
    * x++ uses, defines and uses x. A catch parameter is a definition.
    * The name of a function declaration is defined outside of it, keys of an object literal inside the literal; both also
      serve earlier uses that nothing else defines.
    """
    return _over(trees, _events, _EVENTS).select(*EVENTS)


def _events(tree) -> list[tuple]:
    return Placed(tree).events


def _links(tree) -> list[tuple]:
    return Placed(tree).links()


def _edges(tree) -> list[tuple]:
    return [(s, d, t, b, e, name) for s, d, t, b, e, name in Placed(tree).data()]


def _undeclared(tree) -> list[tuple]:
    return [(name,) for name in {x[0]: None for x in Placed(tree).links() if x[5] is None}]


def resolved_names(trees: DataFrame) -> DataFrame:
    """Each use with the definitions that reach it, or with none: sample_id, name, end_id, t, begin_id, begin_t, how.

    A local name is looked up in all scopes around the use, and the latest definition counts; only if there is none, the
    latest global one does. how: "before"; "branch" for the definitions of true branches that reach it besides the
    latest one, which stands in the false branch; "later" for a function or key that stands after the use; null if the
    use is unknown.
    """
    return _over(trees, _links, _LINKS)


def data_edges(trees: DataFrame) -> DataFrame:
    """Edges from the statement of a definition to the statement of a use: sample_id, src, dst, type (data), ord, begin_id,
    end_id. ord follows the time at which the link is known. Without a statement around either end there is no edge."""
    return _over(trees, _edges, _EDGES).select("sample_id", "src", "dst", F.lit("data").alias("type"), "ord", "begin_id", "end_id", "name")


def undeclared_names(trees: DataFrame) -> DataFrame:
    """Names that are used where nothing defines them, and are not reserved words; each once per tree."""
    return _over(trees, _undeclared, "name string")


def program_flow(trees: DataFrame, level: str, features: str = "ngrams") -> DataFrame:
    """sample_id, units: `flow_units` over the control edges and data edges of trees in JSON, without either in rows."""

    def walk(tree) -> list[tuple]:
        placed = Placed(tree)
        return walked(tree, [(kind, edges_by_source(placed.data() if kind == "data" else placed.control(), kind)) for kind in LEVELS[level]], features)

    return map_trees(trees, walk, NAMES if features == "ngrams" else PAIRS)
