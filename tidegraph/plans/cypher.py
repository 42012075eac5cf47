"""A read-only graph query language: a guarded subset of Cypher compiled to DataFrames.

text -> tokens -> clauses -> checks -> DataFrame. The checks work on the parsed clauses, so comments,
quotes and letter case cannot hide anything from them; the DataFrame is optimised by Catalyst.
"""

from __future__ import annotations

import hashlib
import re
import time
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..plans.contract import RELATIONSHIP_TYPES
from ..session import checkpoint

MAX_HOPS, MAX_ROWS, MAX_LIST = 6, 200, 500
# Words that write, administer or call out.
FORBIDDEN = frozenset("CREATE MERGE DELETE DETACH SET REMOVE DROP FOREACH LOAD CALL SHOW STOP GRANT REVOKE DENY ALTER START TERMINATE USE".split())
FIRST = ("MATCH", "OPTIONAL", "UNWIND", "WITH")


class Rejected(ValueError):
    """The query is outside the guarded subset."""


_LEX = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<num>\d+(?:\.\d+)?(?!\.?\w)|\d+(?=\.\.))|(?P<param>\$\w+)|(?P<id>[^\W\d]\w*|`[^`]*`)"
    r"|(?P<op><>|<=|>=|\.\.|[-()\[\]{}:,.|*=<>+/%])",
    re.S,
)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            c = text[at]
            raise Rejected("text literals are not allowed, use parameters" if c in "'\"" else "dollar quotes are not allowed" if text.startswith("$$", at) else "only one statement is allowed" if c == ";" else f"unexpected {c!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group().strip("`") if m.lastgroup == "id" else m.group()))
        at = m.end()
    return out


@dataclass
class Node:
    var: str
    labels: list[str] = field(default_factory=list)
    props: dict = field(default_factory=dict)


@dataclass
class Rel:
    var: str
    types: list[str]
    direction: str
    low: int = 1
    high: int = 1
    many: bool = False


@dataclass
class Pattern:
    var: str | None
    nodes: list[Node]
    rels: list[Rel]
    shortest: bool = False


@dataclass
class Query:
    parts: list  # ("match", [Pattern], optional) | ("unwind", param, var) | ("where", expression)
    returns: list
    distinct: bool
    order: list
    limit: tuple[str, str]


class Parser:
    def __init__(self, text: str):
        self.t, self.i, self.n = tokens(text), 0, 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def word(self, k: int = 0) -> str:
        return self.peek(k).upper() if self.i + k < len(self.t) and self.t[self.i + k][0] == "id" else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want and got.upper() != want:
            raise Rejected(f"expected {want or 'more'}, found {got or 'the end'}")
        self.i += 1
        return got

    def maybe(self, want: str) -> bool:
        if self.peek().upper() == want:
            self.i += 1
            return True
        return False

    def name(self) -> str:
        self.n += 1
        return f"_{self.n}"

    def query(self) -> Query:
        if self.word() not in FIRST:
            raise Rejected("a query begins with MATCH, OPTIONAL MATCH, UNWIND or WITH")
        parts = []
        while self.word() and self.word() != "RETURN":
            w = self.take().upper()
            if w == "OPTIONAL":
                self.take("MATCH")
                parts.append(("match", self.patterns(), True))
            elif w == "MATCH":
                parts.append(("match", self.patterns(), False))
            elif w == "UNWIND":
                p = self.take()
                if not p.startswith("$"):
                    raise Rejected("UNWIND takes a parameter")
                self.take("AS")
                parts.append(("unwind", p[1:], self.take()))
            elif w == "WHERE":
                parts.append(("where", self.expr()))
            else:
                raise Rejected(f"{w} is not supported")
        self.take("RETURN")
        distinct = self.maybe("DISTINCT")
        returns = [self.item()]
        while self.maybe(","):
            returns.append(self.item())
        order = []
        if self.word() == "ORDER":
            self.take()
            self.take("BY")
            while True:
                e = self.expr()
                down = self.word() in ("DESC", "DESCENDING")
                if down or self.word() in ("ASC", "ASCENDING"):
                    self.take()
                order.append((e, down))
                if not self.maybe(","):
                    break
        if self.word() != "LIMIT":
            raise Rejected("the query must end with a LIMIT")
        self.take()
        limit = self.t[self.i] if self.i < len(self.t) else ("", "")
        self.take()
        if limit[0] not in ("num", "param") or self.i != len(self.t):
            raise Rejected("the query must end with one LIMIT")
        return Query(parts, returns, distinct, order, limit)

    def item(self):
        a = self.i
        e = self.expr()
        text = "".join(x for _, x in self.t[a : self.i])
        return e, (self.take() if self.maybe("AS") else text)

    def patterns(self) -> list[Pattern]:
        out = [self.pattern()]
        while self.maybe(","):
            out.append(self.pattern())
        return out

    def pattern(self) -> Pattern:
        var = None
        if self.peek(1) == "=":
            var = self.take()
            self.take("=")
        short = self.word() == "SHORTESTPATH"
        if short:
            self.take()
            self.take("(")
        nodes, rels = [self.node()], []
        while self.peek() in ("-", "<"):
            rels.append(self.rel())
            nodes.append(self.node())
        if short:
            self.take(")")
        return Pattern(var, nodes, rels, short)

    def node(self) -> Node:
        self.take("(")
        n = Node(self.take() if self.i < len(self.t) and self.t[self.i][0] == "id" else self.name())
        while self.maybe(":"):
            n.labels.append(self.take())
        if self.maybe("{"):
            while True:
                k = self.take()
                self.take(":")
                n.props[k] = self.atom()
                if not self.maybe(","):
                    break
            self.take("}")
        self.take(")")
        return n

    def rel(self) -> Rel:
        back = self.maybe("<")
        self.take("-")
        r = Rel(self.name(), [], "both")
        if self.maybe("["):
            if self.t[self.i][0] == "id":
                r.var = self.take()
            if self.maybe(":"):
                r.types.append(self.take())
                while self.maybe("|"):
                    self.maybe(":")
                    r.types.append(self.take())
            if self.maybe("*"):
                low = self.take()
                if not low.isdigit() or not self.maybe("..") or not self.peek().isdigit():
                    raise Rejected("a path of several edges is written *a..b")
                r.low, r.high, r.many = int(low), int(self.take()), True
            self.take("]")
        self.take("-")
        ahead = self.maybe(">")
        r.direction = "in" if back and not ahead else "out" if ahead and not back else "both"
        return r

    # -- expressions ----------------------------------------------------------
    def expr(self):
        left = self.both()
        while self.word() == "OR":
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.not_()
        while self.word() == "AND":
            self.take()
            left = ("and", left, self.not_())
        return left

    def not_(self):
        if self.word() == "NOT":
            self.take()
            return ("not", self.not_())
        return self.compare()

    def compare(self):
        left = self.atom()
        op = self.peek().upper()
        if op in ("=", "<>", "<", ">", "<=", ">=", "IN", "CONTAINS"):
            self.take()
            return (op, left, self.atom())
        if op in ("STARTS", "ENDS"):
            self.take()
            self.take("WITH")
            return (op, left, self.atom())
        if op == "IS":
            self.take()
            no = self.word() == "NOT"
            if no:
                self.take()
            self.take("NULL")
            return ("notnull" if no else "null", left)
        return left

    def atom(self):
        kind, x = self.t[self.i] if self.i < len(self.t) else ("", "")
        self.take()
        if kind == "num":
            return ("value", float(x) if "." in x else int(x))
        if kind == "param":
            return ("param", x[1:])
        if x == "(":
            e = self.expr()
            self.take(")")
            return e
        if x == "[":
            # a list made of a path: [n IN nodes(p) | n.key]
            v = self.take()
            self.take("IN")
            src = self.atom()
            self.take("|")
            body = self.expr()
            self.take("]")
            return ("each", v, src, body)
        if kind != "id":
            raise Rejected(f"unexpected {x!r}")
        if x.upper() in ("TRUE", "FALSE", "NULL"):
            return ("value", {"TRUE": True, "FALSE": False, "NULL": None}[x.upper()])
        if self.maybe("("):
            f = x.lower()
            if f in ("any", "all", "none"):
                v = self.take()
                self.take("IN")
                src = self.atom()
                self.take("WHERE")
                body = self.expr()
                self.take(")")
                return (f, v, src, body)
            if self.maybe("*"):
                self.take(")")
                return ("call", f, False, [])
            distinct = self.maybe("DISTINCT")
            args = [] if self.peek() == ")" else [self.expr()]
            while self.maybe(","):
                args.append(self.expr())
            self.take(")")
            return ("call", f, distinct, args)
        if self.maybe("."):
            return ("prop", x, self.take())
        return ("var", x)


AGGREGATES = {"count": F.count, "min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "collect": F.collect_list}


def validate(text: str, params: dict | None = None, max_rows: int = MAX_ROWS, rel_types: tuple[str, ...] = RELATIONSHIP_TYPES) -> tuple[Query, int]:
    """(query, row limit) of a text that passes every check; Rejected tells the first that it fails."""
    params = params or {}
    if not text or not text.strip():
        raise Rejected("empty query")
    text = unicodedata.normalize("NFKC", text).strip().removesuffix(";")
    if "$$" in text:
        raise Rejected("dollar quotes are not allowed")
    # words split by comments are checked joined and apart
    for t in (re.sub(r"/\*.*?\*/", "", text, flags=re.S), re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)):
        found = {w.upper() for w in re.findall(r"(?<![\w$.])[^\W\d]\w*", t)} & FORBIDDEN
        if found:
            raise Rejected(f"not read-only: {sorted(found)[0]}")
        if re.search(r"\b(?:apoc|dbms|db)\s*\.", t, re.I):
            raise Rejected("procedures are not allowed")
    q = Parser(text).query()
    for part in q.parts:
        if part[0] == "match":
            for p in part[1]:
                for r in p.rels:
                    if bad := [x for x in r.types if x not in rel_types]:
                        raise Rejected(f"unknown relationship type {bad[0]}")
                    if not 0 <= r.low <= r.high <= MAX_HOPS:
                        raise Rejected(f"paths are limited to {MAX_HOPS} edges")
    names = {x[1:] for k, x in tokens(text) if k == "param"}
    if missing := names - set(params):
        raise Rejected(f"parameter ${sorted(missing)[0]} is missing")
    for k in names:
        if isinstance(params[k], (list, tuple)) and len(params[k]) > MAX_LIST:
            raise Rejected(f"${k} has more than {MAX_LIST} items")
    kind, x = q.limit
    if kind == "param":
        try:
            limit = max(1, min(int(params[x[1:]]), max_rows))
        except (TypeError, ValueError):
            raise Rejected("LIMIT is no number") from None
    else:
        limit = int(float(x))
        if not 1 <= limit <= max_rows:
            raise Rejected(f"LIMIT is above {max_rows}")
    return q, limit


class Compiler:
    """Clauses to a DataFrame. A node variable v is the columns v__id, v__name ...; a path p the columns p__nodes, p__length."""

    def __init__(self, g: Graph, params: dict):
        self.g, self.params = g, params
        self.fields = [c for c in g.vertices.columns]
        self.spark = g.vertices.sparkSession
        self.kinds: dict[str, str] = {}

    def vertex(self, n: Node) -> DataFrame:
        v = self.g.vertices
        if n.labels:
            v = v.where(F.lower("entity_type").isin(*[x.lower() for x in n.labels]))
        for k, e in n.props.items():
            if k not in self.fields:
                v = v.where("false")
            elif e[0] in ("param", "value"):
                v = v.where(F.col(k) == self.expr(e))
        self.kinds[n.var] = "node"
        return v.select(F.col("id").alias(f"{n.var}__id"), *[F.col(c).alias(f"{n.var}__{c}") for c in self.fields if c != "id"])

    def ref(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def match(self, df: DataFrame | None, p: Pattern) -> DataFrame:
        first = p.nodes[0]
        bound = df is not None and f"{first.var}__id" in df.columns
        cur = df if bound else self.vertex(first)
        if df is not None and not bound:
            on = self._bound(first)
            if on is None:
                raise Rejected("a pattern must share a variable with what comes before it")
            cur = df.join(cur, on)
        mark = f"{p.var or '_p'}"
        cur = cur.withColumn(f"{mark}__nodes", F.array(self.ref(f"{first.var}__id"))).withColumn(f"{mark}__rels", F.array().cast("array<string>"))
        at = first
        for r, n in zip(p.rels, p.nodes[1:]):
            adj = self.g.adjacency(r.direction, tuple(r.types) or None).select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("rel_id").alias("__r"), F.col("rel_type").alias("__t"))
            ends = self.vertex(n) if f"{n.var}__id" not in cur.columns else None
            if p.shortest:
                cur = self._shortest(cur, adj, at, n, r, mark, ends)
            else:
                cur = self._hops(cur, adj, at, n, r, mark, ends)
            at = n
        if p.var:
            self.kinds[p.var] = "path"
            return cur.withColumn(f"{p.var}__length", F.size(self.ref(f"{mark}__nodes")) - 1)
        return cur.drop(f"{mark}__nodes", f"{mark}__rels")

    def _bound(self, n: Node) -> Column | None:
        """The properties of n that equal earlier variables."""
        on = None
        for k, e in n.props.items():
            if k in self.fields and e[0] not in ("param", "value"):
                c = self.ref(f"{n.var}__{k}") == self.expr(e)
                on = c if on is None else on & c
        return on

    def _end(self, cur: DataFrame, n: Node, ends: DataFrame | None) -> DataFrame:
        if ends is None:
            return cur.where(self.ref("__d") == self.ref(f"{n.var}__id")).drop("__d")
        cur = cur.join(ends, self.ref("__d") == self.ref(f"{n.var}__id")).drop("__d")
        on = self._bound(n)
        return cur if on is None else cur.where(on)

    def _hops(self, cur, adj, at, n, r: Rel, mark, ends) -> DataFrame:
        walk = cur.withColumn("__d", self.ref(f"{at.var}__id")).withColumn("__k", F.lit(0))
        done = walk if r.low == 0 else None
        for k in range(1, r.high + 1):
            walk = walk.withColumnRenamed("__d", "__s").join(adj, "__s").where(~F.array_contains(self.ref(f"{mark}__rels"), F.col("__r")))
            walk = walk.withColumn(f"{mark}__nodes", F.concat(self.ref(f"{mark}__nodes"), F.array("__d"))).withColumn(f"{mark}__rels", F.concat(self.ref(f"{mark}__rels"), F.array("__r")))
            if not r.many:
                self.kinds[r.var] = "rel"
                walk = walk.withColumn(f"{r.var}__id", F.col("__r")).withColumn(f"{r.var}__type", F.col("__t"))
            walk = walk.drop("__s", "__r", "__t")
            if k >= r.low:
                done = walk if done is None else done.unionByName(walk)
        return self._end(done.drop("__k"), n, ends)

    def _shortest(self, cur, adj, at, n, r: Rel, mark, ends) -> DataFrame:
        """Frontier search: a level holds each (row, node) once, by its smallest path."""
        base = checkpoint(cur.withColumn("__row", F.monotonically_increasing_id()))
        step = checkpoint(adj.select("__s", "__d").distinct())
        seen = checkpoint(base.select("__row", self.ref(f"{at.var}__id").alias("__d"), F.array(self.ref(f"{at.var}__id")).alias("__path")))
        front = seen
        for _ in range(r.high):
            new = front.withColumnRenamed("__d", "__s").join(step, "__s").groupBy("__row", "__d").agg(F.min(F.concat("__path", F.array("__d"))).alias("__path"))
            new = checkpoint(new.join(seen.select("__row", "__d"), ["__row", "__d"], "left_anti"))
            if new.isEmpty():
                break
            seen, front = seen.unionByName(new), new
        got = base.drop(f"{mark}__nodes").join(seen.where(F.size("__path") - 1 >= r.low), "__row").withColumnRenamed("__path", f"{mark}__nodes").drop("__row")
        return self._end(got, n, ends)

    def expr(self, e, scope: dict | None = None) -> Column:
        scope = scope or {}
        k = e[0]
        if k == "value":
            return F.lit(e[1])
        if k == "param":
            v = self.params[e[1]]
            return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
        if k == "var":
            if e[1] in scope:
                return scope[e[1]]
            kind = self.kinds.get(e[1])
            return self.ref(f"{e[1]}__id") if kind in ("node", "rel") else self.ref(f"{e[1]}__nodes") if kind == "path" else self.ref(e[1])
        if k == "prop":
            if e[1] in scope:
                return scope[e[1]]
            if self.kinds.get(e[1]) == "node" and e[2] not in self.fields:
                return F.lit(None).cast("string")
            return self.ref(f"{e[1]}__{e[2]}")
        if k in ("and", "or"):
            a, b = self.expr(e[1], scope), self.expr(e[2], scope)
            return a & b if k == "and" else a | b
        if k == "not":
            return ~self.expr(e[1], scope)
        if k in ("null", "notnull"):
            c = self.expr(e[1], scope)
            return c.isNull() if k == "null" else c.isNotNull()
        if k in ("any", "all", "none"):
            src = F.coalesce(self.expr(e[2], scope), F.array().cast("array<string>"))
            test = lambda x: self.expr(e[3], scope | {e[1]: x})
            return F.exists(src, test) if k == "any" else F.forall(src, test) if k == "all" else ~F.exists(src, test)
        if k == "each":
            return F.transform(self.expr(e[2], scope), lambda x: self.expr(e[3], scope | {e[1]: x}))
        if k == "call":
            return self.call(e, scope)
        a, b = self.expr(e[1], scope), self.expr(e[2], scope)
        return {
            "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
            "IN": lambda: F.array_contains(b, a), "CONTAINS": lambda: F.contains(a, b), "STARTS": lambda: F.startswith(a, b), "ENDS": lambda: F.endswith(a, b),
        }[k]()

    def call(self, e, scope) -> Column:
        _, f, distinct, args = e
        if f == "count" and not args:
            return F.count("*")
        a = [self.expr(x, scope) for x in args]
        if f in AGGREGATES:
            return F.count_distinct(a[0]) if f == "count" and distinct else F.collect_set(a[0]) if f == "collect" and distinct else AGGREGATES[f](a[0])
        if f == "length":
            return self.ref(f"{args[0][1]}__length")
        if f == "nodes":
            return self.ref(f"{args[0][1]}__nodes")
        if f == "type":
            return self.ref(f"{args[0][1]}__type")
        if f == "labels":
            return F.array(self.ref(f"{args[0][1]}__entity_type"))
        simple = {"coalesce": F.coalesce, "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "size": F.size, "abs": F.abs, "id": lambda x: x}
        if f not in simple:
            raise Rejected(f"unknown function {f}")
        return simple[f](*a)

    def run(self, q: Query, limit: int) -> DataFrame:
        df = None
        for part in q.parts:
            if part[0] == "unwind":
                values = self.params[part[1]]
                rows = self.spark.createDataFrame([(x,) for x in values], f"`{part[2]}` string" if not values or isinstance(values[0], str) else f"`{part[2]}` double")
                self.kinds[part[2]] = "value"
                df = rows if df is None else df.crossJoin(rows)  # at most MAX_LIST rows
            elif part[0] == "where":
                df = df.where(self.expr(part[1]))
            else:
                if part[2] and df is not None:
                    # rows are numbered, so that those without a match come back as they were
                    df = checkpoint(df.withColumn("__opt", F.monotonically_increasing_id()))
                new = df
                for p in part[1]:
                    new = self.match(new, p)
                if part[2] and df is not None:
                    more = [c for c in new.columns if c not in df.columns]
                    new = df.join(new.select("__opt", *more), "__opt", "left").drop("__opt")
                df = new
        agg = lambda e: isinstance(e, tuple) and (e[0] == "call" and e[1] in AGGREGATES or any(agg(x) for x in e[1:] if isinstance(x, tuple)) or any(agg(y) for x in e[1:] if isinstance(x, list) for y in x))
        keys = [(e, a) for e, a in q.returns if not agg(e)]
        sums = [(e, a) for e, a in q.returns if agg(e)]
        if sums:
            out = df.groupBy(*[self.expr(e).alias(a) for e, a in keys]).agg(*[self.expr(e).alias(a) for e, a in sums])
            out = out.select(*[self.ref(a) for _, a in q.returns])
            pick = lambda e: self.ref(next((a for x, a in q.returns if x == e or e == ("var", a)), str(e)))
            by = [pick(e).desc() if d else pick(e) for e, d in q.order]
            return out.orderBy(*by).limit(limit) if by else out.limit(limit)
        named = {a: e for e, a in q.returns}
        by = []
        for e, d in q.order:
            c = self.expr(named[e[1]]) if e[0] == "var" and e[1] in named else self.expr(e)
            by.append(c.desc() if d else c)
        cols = [self.expr(e).alias(a) for e, a in q.returns]
        if q.distinct:
            out = df.select(*cols).distinct()
            keep = [self.ref(e[1]) if e[0] == "var" and e[1] in named else self.ref(next((a for x, a in q.returns if x == e), "")) for e, _ in q.order]
            return out.orderBy(*[k.desc() if d else k for k, (_, d) in zip(keep, q.order)]).limit(limit) if keep else out.limit(limit)
        return (df.orderBy(*by) if by else df).select(*cols).limit(limit)


def compile_query(g: Graph, text: str, params: dict | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    q, limit = validate(text, params, max_rows)
    return Compiler(g, params or {}).run(q, limit)


def execute_readonly(g: Graph, text: str, params: dict | None = None, max_rows: int = MAX_ROWS, timeout_s: float = 10.0) -> dict:
    """{rows, truncated, audit}: the rows of a guarded query; its jobs are cancelled after timeout_s."""
    import threading

    spark, began = g.vertices.sparkSession, time.time()
    tag = "q" + hashlib.sha256(f"{text}{began}".encode()).hexdigest()[:16]
    q, limit = validate(text, params, max_rows)
    spark.addTag(tag)
    timer = threading.Timer(timeout_s, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        rows = [r.asDict(recursive=True) for r in Compiler(g, params or {}).run(q, limit + 1).collect()]
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return {
        "rows": rows[:limit],
        "truncated": len(rows) > limit,
        "audit": {"sha256": hashlib.sha256(text.encode()).hexdigest(), "params": sorted(params or {}), "ms": round((time.time() - began) * 1000)},
    }


#: What the loop below asks when its planner is silent.
DEFAULT_PLAN = "MATCH (a)-[r]-(b) WHERE a.id IN $ids RETURN a.id AS source, type(r) AS rel, b.id AS target ORDER BY source, target, rel LIMIT $limit"


def search_loop(g: Graph, ids: list[str], decide=None, rounds: int = 6, row_limit: int = 100) -> dict:
    """Queries until decide(history) returns None, repeats itself or `rounds` is reached; a failed query is noted and the loop goes on.

    decide returns (text, params); without it the default plan is asked once."""
    history, seen = [], set()
    for _ in range(rounds):
        if decide is None:
            step = None if history else (DEFAULT_PLAN, {"ids": ids, "limit": row_limit})
        else:
            step = decide(history)
        if step is None:
            break
        mark = hashlib.sha256(repr(step).encode()).hexdigest()
        if mark in seen:
            break
        seen.add(mark)
        try:
            history.append({"query": step[0], **execute_readonly(g, step[0], step[1], row_limit)})
        except Exception as e:  # noqa: BLE001
            history.append({"query": step[0], "error": str(e)[:300]})
    return {"rounds": history, "rows_observed": sum(len(h.get("rows", ())) for h in history)}
