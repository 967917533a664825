"""Tree and edge tables. Node ids are pre-order, so a subtree is an interval of ids and tree walks are windows.

nodes: sample_id, node_id, parent_id, child_ix, n_children, depth, subtree_end, name, body, attributes, value_type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from unitweave.functions.columns import leaf_value, literal_type
from unitweave.functions.tables import COMMENTS, STATEMENTS, TREE_CODES
from unitweave.functions.walks import JsonTree, RowTree, contexts, control_edges, edges_by_source, flow_names, flow_pairs, name_edges, pairs, read_tree

NODES = "sample_id long, node_id int, parent_id int, child_ix int, n_children int, depth int, subtree_end int, name string, body string, attributes map<string,string>, value_type string"
#: Rows that a task gathers before it hands them on.
ROWS = 20_000


def handed_on(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ROWS; what stands in lists counts too."""
    lists = [k for k, t in enumerate(schema.types) if pa.types.is_list(t)]
    some: list[tuple] = []
    heavy = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        some.append(row)
        for k in lists:
            heavy += len(row[k])
        if len(some) >= ROWS or heavy >= 10 * ROWS:
            yield batch()
            some, heavy = [], 0
    if some:
        yield batch()


def map_trees(trees: DataFrame, of: Callable[[JsonTree], Iterable[tuple]], schema: str, json_col: str = "tree") -> DataFrame:
    """sample_id and the rows that `of` makes of each tree in JSON, read and worked on in one task: no node is stored or
    dealt out. schema: of the rows. Texts that are no tree give no rows."""
    whole = f"sample_id long, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(whole))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for sample_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    tree = read_tree(text.as_py())
                    if tree:
                        key = (sample_id.as_py(),)
                        for row in of(tree):
                            yield key + row

        return handed_on(rows(), arrow)

    return trees.select(F.col("sample_id").cast("long"), json_col).mapInArrow(mapped, whole)


def gathered(nodes: DataFrame, **columns: Column) -> DataFrame:
    """One row per tree: sample_id and its nodes as structs of node_id and columns, in order."""
    return nodes.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("node_id", *[c.alias(k) for k, c in columns.items()]))).alias("nodes"))


def listed(column: pa.Array) -> list:
    """The values of a column; -1 for a missing whole number, False for a missing truth value, None for a missing text."""
    if pa.types.is_integer(column.type):
        return column.fill_null(-1).to_numpy().tolist()
    if pa.types.is_boolean(column.type):
        column = column.fill_null(False)
    return column.to_numpy(zero_copy_only=False).tolist()


def in_lists(column: pa.ListArray) -> Iterator[list]:
    """Of each row, its values as `listed`."""
    values, at = listed(column.flatten()), 0
    for n in column.value_lengths().to_pylist():
        yield values[at : at + (n or 0)]
        at += n or 0


def structs(column: pa.ListArray) -> Iterator[dict[str, list]]:
    """Of each row, the fields of its structs as lists."""
    fields, at = {f.name: listed(c) for f, c in zip(column.type.value_type, column.flatten().flatten(), strict=True)}, 0
    for n in column.value_lengths().to_pylist():
        yield {k: c[at : at + (n or 0)] for k, c in fields.items()}
        at += n or 0


def map_nodes(nodes: DataFrame, of: Callable[[RowTree], Iterable[tuple]], schema: str, columns: dict[str, Column]) -> DataFrame:
    """`map_trees` for trees in rows, whose nodes meet in one task per tree. columns: name, parent_id, and what `of` asks for."""
    whole = f"sample_id long, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(whole))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for sample_id, known in zip(batch.column(0).to_pylist(), structs(batch.column(1)), strict=True):
                    for row in of(RowTree(known.pop("name"), known.pop("parent_id"), known, known.pop("body", None))):
                        yield sample_id, *row

        return handed_on(rows(), arrow)

    return gathered(nodes, **columns).select(F.col("sample_id").cast("long"), "nodes").mapInArrow(mapped, whole)


def _node_rows(tree: JsonTree) -> Iterator[tuple]:
    """Rows of one tree."""
    parents, ends = tree.parents, tree.ends
    depth, children = [0] * len(parents), [0] * len(parents)
    for k in range(1, len(parents)):
        depth[k] = depth[parents[k]] + 1
        children[parents[k]] += 1
    for k, name in enumerate(tree.names):
        yield (
            k, parents[k] if k else None, tree.places[k], children[k], depth[k], ends[k], name, tree.roles[k],
            list(tree.attributes(k).items()), tree.value_type(k),
        )


def flatten_tree(trees: DataFrame, json_col: str = "tree") -> DataFrame:
    """Trees as JSON, one per sample, to nodes. Texts that are no tree (no JSON, no object with a type, a type that is no
    text, deeper than the JSON reader goes) give no rows."""
    return map_trees(trees, _node_rows, NODES.split(", ", 1)[1], json_col)


def ast_units(nodes: DataFrame) -> DataFrame:
    """Names of all nodes but the root, in pre-order."""
    item = F.when(F.col("parent_id").isNotNull(), F.struct("node_id", "name"))
    return nodes.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["name"]).alias("units"))


def subtree_size(nodes: DataFrame) -> DataFrame:
    """Descendants of each node."""
    return nodes.select("sample_id", "node_id", (F.col("subtree_end") - F.col("node_id")).alias("descendants"))


def context_values(nodes: DataFrame) -> DataFrame:
    """(name, first Identifier at or below the node in pre-order); no row if there is none.

    The next Identifier from the node on, kept if it lies in the node's subtree: one window for all nodes.
    """
    onward = Window.partitionBy("sample_id").orderBy("node_id").rowsBetween(0, Window.unboundedFollowing)
    found = F.first(
        F.when(F.col("name") == "Identifier", F.struct("node_id", F.element_at("attributes", "name").alias("ident"))),
        ignorenulls=True,
    ).over(onward)
    return nodes.withColumn("context", found).where(
        F.col("context.node_id") <= F.col("subtree_end")
    ).withColumn("value", F.col("context.ident")).drop("context")


def ast_value_features(nodes: DataFrame) -> DataFrame:
    """(unit, value) of each node but the root: of literals type and value, of others name and context; in pre-order rows."""
    codes = F.create_map(*[F.lit(x) for kv in TREE_CODES.items() for x in kv])
    literals = nodes.where(
        (F.col("name") == "Literal") & F.map_contains_key("attributes", F.lit("value")) & F.col("parent_id").isNotNull()
    )
    literals = literals.select(
        "sample_id",
        "node_id",
        literal_type(F.col("value_type"), F.col("attributes")).alias("name"),
        leaf_value(F.col("attributes")).alias("value"),
    )
    others = context_values(nodes).where(
        (F.col("name") != "Literal") & F.col("parent_id").isNotNull()
    ).select("sample_id", "node_id", "name", "value")
    return literals.unionByName(others).withColumn("unit", F.element_at(codes, F.col("name")))


def nearest_statement(nodes: DataFrame, statements: list[str] = STATEMENTS) -> DataFrame:
    """Nearest statement at or above each node; null if there is none.

    Two windows over one order. The level of a node is the number of statements at or above it: statements that began up to
    here, less those whose subtrees have ended. The nearest one is the last statement that began at this level.
    """
    is_statement = F.col("name").isin(statements)
    begins = nodes.select(
        "sample_id", F.col("node_id").alias("at"), F.lit(1).alias("side"), is_statement.cast("int").alias("step"), "node_id"
    )
    ends = nodes.where(is_statement).select(
        "sample_id", (F.col("subtree_end") + 1).alias("at"), F.lit(0).alias("side"), F.lit(-1).alias("step"), "node_id"
    )
    running = Window.partitionBy("sample_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    leveled = begins.unionByName(ends).withColumn("level", F.sum("step").over(running)).where("side = 1")
    here = Window.partitionBy("sample_id", "level").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("step") == 1, F.col("node_id")), ignorenulls=True).over(here)
    return leveled.select("sample_id", "node_id", F.when(F.col("level") > 0, last).cast("int").alias("statement"))


#: Type of the edge from a parent to a child, as text: type and label. p: parent, c: child, last: last case of a switch,
#: before: the sibling before the child.
EDGE_RULE = """
CASE WHEN p_name = 'DoWhileStatement' THEN CASE WHEN c_ix = 0 THEN 'control true' WHEN c_ix = 1 THEN link WHEN c_ix = 2 AND c_comment THEN 'comment c' END
WHEN p_name IN ('ForStatement', 'ForOfStatement', 'ForInStatement') THEN CASE WHEN c_body = 'body' THEN CASE WHEN NOT c_comment THEN 'control true' END ELSE link END
WHEN p_name IN ('IfStatement', 'ConditionalExpression') THEN CASE WHEN c_ix = 0 THEN link WHEN c_ix = 1 THEN 'control true' WHEN c_ix = 2 THEN CASE WHEN c_comment THEN 'comment c' ELSE 'control false' END WHEN c_ix = 3 AND c_comment AND NOT before_comment THEN 'comment c' END
WHEN p_name = 'TryStatement' THEN CASE WHEN c_ix = 0 THEN 'control true' WHEN c_ix = 1 THEN CASE WHEN c_body = 'handler' THEN 'control false' ELSE 'control e' END
  WHEN c_ix = 2 THEN CASE WHEN c_body = 'finalizer' THEN 'control e' WHEN c_comment THEN 'comment c' END WHEN c_ix = 3 AND c_comment AND before_body = 'finalizer' THEN 'comment c' END
WHEN p_name = 'WhileStatement' THEN CASE WHEN c_ix = 0 THEN link WHEN c_ix = 1 THEN 'control true' WHEN c_ix = 2 AND c_comment THEN 'comment c' END
WHEN p_name = 'SwitchStatement' THEN CASE WHEN c_ix = 0 THEN link WHEN c_ix = 1 THEN 'control e' WHEN c_comment THEN 'comment c' ELSE 'control false' END
WHEN p_name = 'SwitchCase' THEN CASE WHEN p_n = 1 THEN 'control true' WHEN p_last AND p_ix >= 2 THEN CASE WHEN c_comment THEN 'comment c' ELSE 'control true' END
  WHEN c_ix = 0 THEN link WHEN c_comment THEN 'comment c' ELSE 'control true' END
ELSE CASE WHEN c_statement THEN 'control e' ELSE link END END"""


def structure_edges(nodes: DataFrame) -> DataFrame:
    """Control, statement and comment edges by parent name and child place; the root has none.

    One self-join on the parent; siblings and the last case of a switch come from windows over the children.
    """
    siblings = Window.partitionBy("sample_id", "parent_id").orderBy("child_ix")
    placed = nodes.withColumn("before_id", F.lag("node_id").over(siblings)).withColumn("before_body", F.lag("body").over(siblings)).withColumn(
        "before_comment", F.lag("name").over(siblings).isin(COMMENTS)
    )
    p = placed.select(
        "sample_id",
        F.col("node_id").alias("p_id"),
        F.col("name").alias("p_name"),
        F.col("n_children").alias("p_n"),
        F.col("child_ix").alias("p_ix"),
        F.col("parent_id").alias("pp"),
    )
    top = nodes.select("sample_id", F.col("node_id").alias("pp"), F.col("name").alias("pp_name"), F.col("n_children").alias("pp_n"))
    p = p.where("pp is not null").join(top, ["sample_id", "pp"]).withColumn(
        "p_last", (F.col("pp_name") == "SwitchStatement") & (F.col("p_ix") == F.col("pp_n") - 1)
    )
    c = placed.select(
        "sample_id",
        F.col("parent_id").alias("p_id"),
        F.col("node_id").alias("c_id"),
        F.col("name").alias("c_name"),
        F.col("child_ix").alias("c_ix"),
        F.col("body").alias("c_body"),
        "before_id",
        "before_body",
        "before_comment",
    )
    joined = c.join(p, ["sample_id", "p_id"]).withColumn(
        "c_statement", F.col("c_name").isin(STATEMENTS)
    ).withColumn("c_comment", F.col("c_name").isin(COMMENTS))
    joined = joined.withColumn(
        "link", F.when(F.col("c_comment"), "comment c").otherwise("statement s")
    ).withColumn("edge", F.expr(EDGE_RULE)).where("edge is not null")
    chain = (F.col("p_name") == "SwitchStatement") & (F.col("c_ix") >= 2) & ~F.col("c_comment")
    return joined.select(
        "sample_id",
        F.when(chain, F.col("before_id")).otherwise(F.col("p_id")).alias("src"),
        F.col("c_id").alias("dst"),
        F.split("edge", " ")[0].alias("type"),
        F.split("edge", " ")[1].alias("label"),
        F.col("c_ix").alias("ord"),
    )


def def_use_edges(events: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Each use with the latest definition before it, else with the first function defined after it: an as-of join by
    windows. With nodes, edges go from statement to statement, and uses or definitions outside of any are dropped.

    events: sample_id, scope, pos, k, name, kind (def, use), is_function.
    """
    ordered = Window.partitionBy("sample_id", "scope", "name").orderBy("pos", "k")
    before = F.last(
        F.when(F.col("kind") == "def", F.col("pos")), ignorenulls=True
    ).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(
        F.when((F.col("kind") == "def") & F.col("is_function"), F.col("pos")), ignorenulls=True
    ).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    uses = events.withColumn("begin_id", F.coalesce(before, after)).where("kind = 'use' and begin_id is not null")
    edges = uses.select("sample_id", "scope", "name", "begin_id", F.col("pos").alias("end_id"), F.col("k").alias("ord"))
    if nodes is None:
        return edges
    near = nearest_statement(nodes)
    at = lambda c, out: near.select(
        "sample_id", F.col("node_id").alias(c), F.col("statement").alias(out)
    ).where(F.col(out).isNotNull())
    return edges.join(at("begin_id", "src"), ["sample_id", "begin_id"]).join(at("end_id", "dst"), ["sample_id", "end_id"])


def undeclared_identifiers(events: DataFrame, reserved: DataFrame) -> DataFrame:
    """Names used without any definition to link to, unless lower-cased they are reserved (column word)."""
    linked = def_use_edges(events).select("sample_id", "scope", "name", F.col("end_id").alias("pos"), F.col("ord").alias("k"))
    unmatched = events.where("kind = 'use'").join(linked, ["sample_id", "scope", "name", "pos", "k"], "left_anti")
    return unmatched.join(reserved, F.lower("name") == F.col("word"), "left_anti").select("sample_id", "name").distinct()


#: Edges that the walks of a level follow, one kind after the other.
LEVELS = {"cfg": ["control"], "pdg-dfg": ["data"], "pdg": ["data", "control"]}
NAMES = "units array<string>"
PAIRS = "units array<struct<unit:string,value:string>>"


def walked_columns(features: str) -> dict[str, Column]:
    """What walks ask of nodes."""
    columns = {"name": F.col("name"), "parent_id": F.col("parent_id"), "ident": F.element_at("attributes", "name")}
    if features == "value":
        columns |= {
            "leaf": leaf_value(F.col("attributes")), "literal": literal_type(F.col("value_type"), F.col("attributes")),
            "has_value": F.map_contains_key("attributes", F.lit("value")),
        }
    return columns


def walked(tree, edges: list[tuple[str, dict]], features: str) -> list[tuple]:
    """The one row of a tree: units of walks over tables of edges (`edges_by_source`)."""
    if features == "ngrams":
        return [(flow_names(tree, edges),)]
    ctx, _ = contexts(tree)
    return [(flow_pairs(tree, edges, ctx, pairs(tree, ctx)),)]


def flow_units(nodes: DataFrame, edges: DataFrame, level: str, features: str = "ngrams") -> DataFrame:
    """Units along control edges (cfg), data edges (pdg-dfg), or both one after the other (pdg), per sample.

    edges: sample_id, src, dst, type, ord, and for data edges begin_id, end_id. Control edges of a node go by target,
    so a case's own statements come before the next case; data edges go by ord. features "value" gives (unit, value)
    pairs. Order-dependent, so each sample is walked by one task, with explicit stacks.
    """
    schema = f"sample_id long, {NAMES if features == 'ngrams' else PAIRS}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    ends = [F.col(c).cast("long").alias(c) if c in edges.columns else F.lit(None).cast("long").alias(c) for c in ("begin_id", "end_id")]
    fields = ["src", "dst", F.col("ord").cast("long").alias("ord"), *ends]
    flat = edges.where(F.col("type").isin(LEVELS[level])).groupBy("sample_id").agg(F.collect_list(F.struct("type", *fields)).alias("edges"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for sample_id, known, arcs in zip(batch.column(0).to_pylist(), structs(batch.column(1)), structs(batch.column(2)), strict=True):
                    tree = RowTree(known.pop("name"), known.pop("parent_id"), known)
                    own = {kind: [] for kind in LEVELS[level]}
                    for kind, s, d, *rest in zip(*arcs.values(), strict=True):
                        if 0 <= s < len(tree.names):
                            own[kind].append((s, d, *rest))
                    for row in walked(tree, [(kind, edges_by_source(some, kind)) for kind, some in own.items()], features):
                        yield sample_id, *row

        return handed_on(rows(), arrow)

    both = gathered(nodes, **walked_columns(features)).join(flat, "sample_id", "full")
    return both.select(F.col("sample_id").cast("long"), "nodes", "edges").mapInArrow(mapped, schema)


def name_flow(nodes: DataFrame, level: str, features: str = "ngrams") -> DataFrame:
    """`flow_units` over the control edges of trees (`structure_edges`), and data edges from statement to statement between
    the definitions and uses of names (`def_use_edges`): an Identifier that is a first child defines its name, others use
    the latest definition before them. Edges are made where they are walked, so that only nodes meet.
    """
    kinds = LEVELS[level]

    def walk(tree) -> list[tuple]:
        edges = {"control": lambda: control_edges(tree), "data": lambda: name_edges(tree)}
        return walked(tree, [(kind, edges_by_source(edges[kind](), kind)) for kind in kinds], features)

    return map_nodes(nodes, walk, NAMES if features == "ngrams" else PAIRS, walked_columns(features) | {"body": F.col("body")})
