"""Small builders of syntax trees for tests, and programs drawn at random."""


def node(type_, /, **fields):
    return {"type": type_, **fields}


def name(x):
    return node("Identifier", name=x) if isinstance(x, str) else x


def literal(v):
    return node("Literal", value=v)


def declare(x, init=None, kind="var"):
    declarator = node("VariableDeclarator", id=name(x), **({} if init is None else {"init": name(init)}))
    return node("VariableDeclaration", declarations=[declarator], kind=kind)


def say(e):
    return node("ExpressionStatement", expression=name(e))


def assign(left, right, operator="="):
    return node("AssignmentExpression", operator=operator, left=name(left), right=name(right))


def member(of, what, computed=False):
    return node("MemberExpression", computed=computed, object=name(of), property=name(what))


def call(f, *arguments):
    return node("CallExpression", callee=name(f), arguments=[name(x) for x in arguments])


def update(x):
    return node("UpdateExpression", operator="++", argument=name(x), prefix=False)


def block(*body):
    return node("BlockStatement", body=list(body))


def function(x, parameters, *body):
    return node("FunctionDeclaration", id=name(x), params=[name(p) for p in parameters], body=block(*body))


def lambda_(parameters, *body, own=None):
    return node("FunctionExpression", id=own and name(own), params=[name(p) for p in parameters], body=block(*body))


def choose(test, yes, no=None):
    return node("IfStatement", test=name(test), consequent=yes, **({} if no is None else {"alternate": no}))


def while_(test, body):
    return node("WhileStatement", test=name(test), body=body)


def do_while(body, test):
    return node("DoWhileStatement", body=body, test=name(test))


def try_(body, parameter, handler, finalizer=None):
    caught = node("CatchClause", param=name(parameter), body=handler)
    return node("TryStatement", block=body, handler=caught, **({} if finalizer is None else {"finalizer": finalizer}))


def switch(of, *cases):
    return node("SwitchStatement", discriminant=name(of), cases=[node("SwitchCase", test=literal(k), consequent=list(c)) for k, c in enumerate(cases)])


def literal_object(**fields):
    return node("ObjectExpression", properties=[node("Property", key=name(k), computed=False, value=name(v), kind="init") for k, v in fields.items()])


def this():
    return node("ThisExpression")


def program(*body):
    return node("Program", body=list(body))


def random_program(rng, size=12, depth=4):
    """A program over few names, with all kinds of statements nested."""

    def x():
        return rng.choice("abc")

    def statements(n, d):
        return [statement(d) for _ in range(rng.randint(0, n))]

    def statement(d):
        simple = [
            lambda: say(x()), lambda: declare(x(), x()), lambda: declare(x(), literal(1), "let"), lambda: say(assign(x(), x())), lambda: say(assign(x(), literal(2), "+=")),
            lambda: say(update(x())), lambda: say(assign(member(x(), "p"), x())), lambda: say(call(member(x(), "m"), x())), lambda: say(assign(member(x(), x(), True), x())),
            lambda: say(call(x(), x())), lambda: say(assign(x(), literal_object(**{x(): x()}))), lambda: say(member(this(), x())), lambda: say(assign(member("window", x()), x())),
        ]
        nested = [
            lambda: block(*statements(3, d - 1)), lambda: choose(x(), block(*statements(3, d - 1)), block(*statements(3, d - 1))), lambda: choose(x(), block(*statements(2, d - 1))),
            lambda: while_(x(), block(*statements(3, d - 1))), lambda: do_while(block(*statements(3, d - 1)), x()), lambda: function(x(), [x()], *statements(4, d - 1)),
            lambda: say(assign(x(), lambda_([x()], *statements(4, d - 1)))), lambda: try_(block(*statements(2, d - 1)), x(), block(*statements(2, d - 1)), rng.choice([None, block(*statements(2, d - 1))])),
            lambda: switch(x(), *[statements(2, d - 1) for _ in range(rng.randint(1, 4))]), lambda: choose(x(), block(*statements(2, d - 1)), choose(x(), block(*statements(2, d - 1)), block(*statements(2, d - 1)))),
        ]
        return rng.choice(nested if d > 0 and rng.random() < 0.45 else simple)()

    return program(*[statement(depth) for _ in range(size)])
