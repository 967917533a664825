"""Events, scopes, branches and links of names: each rule by a small program, and random programs by brute force."""

import json
import random

from programs import (
    assign, block, call, choose, declare, do_while, function, lambda_, literal, literal_object, member, name, node, program, random_program, say, switch, this, try_, update, while_,
)
from pyspark.sql import functions as F

from unitweave.functions.tables import RESERVED, STATEMENTS
from unitweave.operators import dataflow as df
from unitweave.operators import trees as tr

ONE = literal(1)
#: Programs with their events in order: name, kind, and whether it may serve earlier uses (*) or stays quiet (?).
RULES = {
    "plain, member, this, window, index": (
        [say("a"), say(member("a", "p")), say(member(this(), "x")), say(member("window", "y")), say(member("a", "i", True)), say(member(member("a", "b"), "c"))],
        "a use, a use, x use, y use, a use, i use, a use",
    ),
    "declarator before its initialiser": ([declare("a", "b"), declare("c", kind="let")], "a def, b use, c def"),
    "pattern": ([declare(node("ArrayPattern", elements=[name("a"), name("b")]), "c")], "a def, b def, c use"),
    "assignment": ([say(assign("a", "a"))], "a def, a use"),
    "compound assignment": ([say(assign("a", "b", "+="))], "a def, a use, b use"),
    "member write": ([say(assign(member("a", "p"), "b")), say(assign(member("a", "i", True), "b"))], "a use?, a def, b use, a use, i use, b use"),
    "write to this and window": ([say(assign(member(this(), "x"), ONE)), say(assign(member("window", "y"), ONE)), say(assign(member(member(this(), "o"), "p"), ONE))], "x def, y def, o use?, o def"),
    "object literal inside a target": ([say(assign(member(literal_object(k="v"), "i", True), "b"))], "i use, b use"),
    "update": ([say(update("a"))], "a use, a def, a use"),
    "call on an object that is known": ([declare("a", ONE), say(call(member("a", "m"), "b"))], "a def, a use?, a def, b use"),
    "plain call": ([say(call("f", "a"))], "f use, a use"),
    "catch": ([try_(block(say("a")), "e", block(say("e")), block(say("z")))], "z use, a use, e def, e use"),
    "loop with its test last": ([do_while(block(say("a")), "b")], "b use, a use"),
    "function": ([function("f", ["a"], say("a"))], "f def*, a def, a use"),
    "function expression": ([declare("g", lambda_(["a"], say("a"), own="h"))], "g def, h def, a def, a use"),
    "object keys": ([say(call("f", literal_object(k="v")))], "f use, k def*, v use"),
}


def flattened(spark, programs):
    rows = [(k, json.dumps(p)) for k, p in enumerate(programs)]
    return tr.flatten_tree(spark.createDataFrame(rows, "sample_id long, tree string")).cache()


def test_events_by_rule(spark):
    nodes = flattened(spark, [program(*body) for body, _ in RULES.values()])
    found = df.identifier_events(nodes).collect()
    for k, (rule, (_, want)) in enumerate(RULES.items()):
        got = [f"{e.name} {e.kind}" + "*" * e.is_function + "?" * e.quiet for e in sorted((e for e in found if e.sample_id == k), key=lambda e: e.t)]
        assert ", ".join(got) == want, rule


#: Programs with what each use of a name sees: the definitions by their number in tree order of identifiers (from 0), after
#: the number of the use; "-" if nothing defines it.
LINKS = {
    "the latest one": ([declare("a", ONE), say(assign("a", ONE)), say("a")], "2: 1"),
    "an assignment reads itself": ([declare("a", ONE), say(assign("a", "a"))], "2: 1"),
    "inner names end with their function": ([declare("a", ONE), function("f", [], declare("a", ONE), say("a")), say("a")], "3: 2, 4: 0"),
    "inner uses find outer names": ([declare("a", ONE), function("f", [], say("a"), function("g", [], say("a")))], "2: 0, 4: 0"),
    "locals go before later globals": ([function("f", ["a"], function("g", [], say(assign("b", ONE))), say("a"), say("b"))], "4: 1, 5: 3"),
    "writes to outer locals end with the writer": ([function("f", [], declare("a", ONE), function("g", [], say(assign("a", ONE)), say("a")), say("a"))], "4: 3, 5: 1"),
    "undeclared writes are global": ([function("f", [], say(assign("a", ONE))), say("a")], "2: 1"),
    "let ends with its block": ([function("f", [], declare("a", ONE), block(declare("a", ONE, "let"), say("a")), say("a"))], "3: 2, 4: 1"),
    "let of the top level is global": ([block(declare("a", ONE, "let")), say("a")], "1: 0"),
    "both branches": ([declare("a", ONE), choose("a", block(say(assign("a", ONE))), block(say(assign("a", ONE)))), say("a")], "1: 0, 4: 2 3"),
    "one branch": ([declare("a", ONE), choose("a", block(say(assign("a", ONE)))), say("a")], "1: 0, 3: 2"),
    "the other branch is not seen": ([declare("a", ONE), choose("a", block(say(assign("a", ONE))), block(say("a")))], "1: 0, 3: 0"),
    "branches in branches": (
        [choose("t", block(say(assign("a", ONE))), block(choose("t", block(say(assign("a", ONE))), block(say(assign("a", ONE)))))), say("a")], "0: -, 1: , 2: -, 5: 1 3 4",
    ),
    "cases": ([switch("t", [say(assign("a", ONE))], [say("a"), say(assign("a", ONE))], [say(assign("a", ONE))]), say("a")], "0: -, 2: -, 5: 1 3 4"),
    "a loop's body": ([declare("a", ONE), while_("a", block(say(assign("a", ONE)))), say("a")], "1: 0, 3: 2"),
    "functions serve earlier uses": ([say(call("f")), function("f", [])], "0: 1"),
    "keys serve earlier uses": ([say("k"), say(call("g", literal_object(k=ONE)))], "0: 2, 1: -"),
    "variables do not": ([say("a"), declare("a", ONE)], "0: -"),
    "calls define what is known": ([declare("a", ONE), say(call(member("a", "m"))), say("a"), say(call(member("console", "log"))), say("console")], "1: 0, 3: 1, 6: "),
    "member writes use and define": ([say(assign(member("a", "p"), ONE)), say(assign(member("a", "q"), ONE)), say("a")], "2: 0, 4: 2"),
    "updates use and define": ([declare("a", ONE), say(update("a")), say("a")], "1: 0 1, 2: 1"),
    "keys end with their literal": ([say(call("f", literal_object(k=ONE, j="k"))), say("k")], "0: -, 3: 1, 4: -"),
}


def test_links_by_rule(spark):
    nodes = flattened(spark, [program(*body) for body, _ in LINKS.values()])
    found = df.resolved_names(nodes).collect()
    ids = {}
    for n in sorted(nodes.where("name = 'Identifier'").collect(), key=lambda n: (n.sample_id, n.node_id)):
        ids.setdefault(n.sample_id, []).append(n.node_id)
    for k, (rule, (_, want)) in enumerate(LINKS.items()):
        got = {}
        for r in found:
            if r.sample_id == k:
                got.setdefault(ids[k].index(r.end_id), set()).add("-" if r.how is None else ids[k].index(r.begin_id))
        wanted = {int(x.split(":")[0]): {v if v == "-" else int(v) for v in x.split(":")[1].split()} for x in want.split(", ")}
        assert got == {u: s for u, s in wanted.items() if s}, rule


def brute_links(rows, events):
    """(use, definition) pairs of one sample, by definition: a definition reaches a use if the use can see it and nothing
    that the use can see, and that is no alternative to it, stands between them."""
    node_of = {r.node_id: r for r in rows}
    up = lambda n: [] if n is None else [n, *up(node_of[n].parent_id)]
    kinds = lambda n, names: [x for x in up(n) if node_of[x].name in names]
    homes = lambda n: [x for x in up(n) if node_of[x].name in ("FunctionDeclaration", "FunctionExpression", "ObjectExpression") or node_of[x].parent_id is None]
    scopes = {e.scope for e in events if e.scope not in (None, df.GLOBAL)}
    # branches: of each statement with two of them, the ids of nodes in either
    sides = {}
    for r in rows:
        kids = sorted((x for x in rows if x.parent_id == r.node_id), key=lambda x: x.child_ix)
        if r.name in ("IfStatement", "ConditionalExpression") and len(kids) == 3:
            sides[r.node_id] = ([kids[1]], [kids[2]])
        if r.name == "TryStatement":
            sides[r.node_id] = ([kids[0]], [kids[1]])
        if r.name == "SwitchStatement":
            for i, case in enumerate(kids[1:-1], 1):
                own = sorted((x for x in rows if x.parent_id == case.node_id), key=lambda x: x.child_ix)
                if len(own) > 1:
                    sides[case.node_id] = (own[1:], kids[i + 1 :])
    inside = lambda tops, n: any(t.node_id <= n <= t.subtree_end for t in tops)
    in_ = {s: tuple(lambda n, tops=tops: inside(tops, n) for tops in both) for s, both in sides.items()}
    hides = lambda d, u: any(yes(d) and no(u) for yes, no in in_.values())
    seen_from = lambda u: {*(s for s in up(u.at) if s in scopes or s in homes(u.at)), df.GLOBAL}
    # scopes of written names, in order of time
    placed = {e.t: e.scope for e in events if e.how == "declare"}
    for e in sorted((e for e in events if e.how in ("assign", "call")), key=lambda e: e.t):
        before = [d for d in events if d.name == e.name and d.t < e.t and not hides(d.pos, e.pos)]
        local = [d.scope for d in before if d.how == "declare" and d.scope in seen_from(e) - {df.GLOBAL}]
        scope = df.GLOBAL if e.top or not local else max(*local, homes(e.pos)[0])
        if e.how == "call" and not local and not any(d.how != "call" and placed.get(d.t) == df.GLOBAL for d in before if d.kind == "def"):
            continue
        placed[e.t] = scope
    defs = [d for d in events if d.kind == "def" and d.t in placed]
    links, unknown = set(), []
    for u in (e for e in events if e.kind == "use"):
        for local in (True, False):
            if local and u.quiet and u.top:
                continue
            fit = [d for d in defs if d.name == u.name and d.t < u.t and not hides(d.pos, u.pos) and placed[d.t] in seen_from(u) and (placed[d.t] != df.GLOBAL) == local]
            alternative = lambda d, k: any(yes(d.pos) and no(k.pos) for yes, no in in_.values())
            if fit:  # only definitions of the latest one's scope are merged with it
                latest = max(fit, key=lambda d: d.t)
                same = [d for d in fit if placed[d.t] == placed[latest.t]]
                links |= {(u.t, d.t) for d in same if not any(k.t > d.t and not alternative(d, k) for k in same)}
                break
        else:
            if not u.quiet and u.name.lower() not in {w.lower() for w in RESERVED}:
                later = [d.t for d in events if d.is_function and d.name == u.name and d.t > u.t]
                links.add((u.t, min(later, default=None)))
    return links


def test_random_programs_by_brute_force(spark):
    rng = random.Random(0)
    nodes = flattened(spark, [random_program(rng) for _ in range(150)])
    rows, events = {}, {}
    for r in nodes.collect():
        rows.setdefault(r.sample_id, []).append(r)
    for e in df.identifier_events(nodes).collect():
        events.setdefault(e.sample_id, []).append(e)
    found = {}
    for r in df.resolved_names(nodes).collect():
        found.setdefault(r.sample_id, set()).add((r.t, r.begin_t))
    for sample, some in events.items():
        assert len({e.t for e in some}) == len(some)
        assert found.get(sample, set()) == brute_links(rows[sample], some), sample


def test_enclosing_intervals_and_nearest_marks(spark):
    rng = random.Random(8)
    nodes = flattened(spark, [random_program(rng) for _ in range(20)])
    rows = nodes.collect()
    at = {(r.sample_id, r.node_id): r for r in rows}

    def marked(r):
        out = []
        while r is not None:
            if r.name in STATEMENTS:
                out.append(r.node_id)
            r = at.get((r.sample_id, r.parent_id))
        return out

    want = {k: marked(r) for k, r in at.items()}
    near = {(r.sample_id, r.node_id): r.statement for r in tr.nearest_statement(nodes).collect()}
    assert near == {k: (v or [None])[0] for k, v in want.items()}
    spans = nodes.where(F.col("name").isin(STATEMENTS)).select("sample_id", F.col("node_id").alias("begin"), F.col("subtree_end").alias("end"))
    points = nodes.select("sample_id", F.col("node_id").alias("point"))
    found = {}
    for r in df.enclosing(points, spans, ["begin"]).collect():
        found.setdefault((r.sample_id, r.point), []).append((r.level, r.begin))
    assert {k: [b for _, b in sorted(v, reverse=True)] for k, v in found.items()} == {k: v for k, v in want.items() if v}


def test_data_edges_join_statements_and_empty_tables(spark):
    nodes = flattened(spark, [program(declare("a", ONE), say("a"), say("q"))])
    assert [(r.src, r.dst, r.begin_id, r.end_id) for r in df.data_edges(nodes).collect()] == [(1, 5, 3, 6)]
    assert [r.name for r in df.undeclared_names(nodes).collect()] == ["q"]
    assert df.data_edges(nodes.limit(0)).count() == 0
