"""The query language: text to checked query to DataFrame plan.

    <collection> [where <condition> {and|or <condition>}]
                 [where traverse(<edges>, depth=N, edge='t', direction=d) from '<ref>']
                 [as of '<time>'] [order by <field> [asc|desc]] [limit N]

Clauses come in any order, each at most once; words of the language may be in
any case; ``and`` binds tighter than ``or``.  Strings may be quoted either way,
numbers may be negative, and a traversal may be ordered by ``id`` or ``ref``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotlog.functions.text import split_ref
from knotlog.operators.eventlog import as_of_highest
from knotlog.operators.graph import DEFAULT_DEPTH, VISITED_CAP, reachable
from knotlog.schema import INDEXED, Registry
from knotlog.sources.store import Seek, Store


class QueryError(ValueError):
    """A query that cannot be run."""


class SyntaxProblem(QueryError):
    """The text is no query."""


class UnknownCollection(QueryError):
    """No such collection."""


class UnknownField(QueryError):
    """No such field in the collection."""


class IncompatibleOperator(QueryError):
    """The operator does not go with the field's kind."""


class CapExceeded(RuntimeError):
    """A traversal met more references than allowed; its rows are a part."""


_TOKEN = re.compile(r"""\s*(?:(?P<string>'[^']*'|"[^"]*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<mark>!=|<=|>=|[=<>.(),]))""")


@dataclass(frozen=True)
class Token:
    """A piece of a query's text."""

    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    """The tokens of a query; raises ``SyntaxProblem`` at what is none."""
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            rest = text[at:].lstrip()
            what = "unterminated string" if rest[0] in "'\"" else f"unexpected {rest[0]!r}"
            raise SyntaxProblem(f"{what} at {len(text) - len(rest)}")
        kind = m.lastgroup
        value = m[kind]
        out.append(Token(kind, value[1:-1] if kind == "string" else value, m.start(kind)))
        at = m.end()
    return out


@dataclass(frozen=True)
class Condition:
    """A field compared with a value."""

    field: str
    op: str
    value: str | float | bool


@dataclass(frozen=True)
class Traverse:
    """A walk over links from one reference."""

    edges: str
    start: str
    depth: int = 0
    edge_type: str = ""
    direction: str = "forward"


@dataclass
class Query:
    """A parsed query; ``where`` is a disjunction of conjunctions."""

    collection: str
    where: list[list[Condition]] = field(default_factory=list)
    traverse: Traverse | None = None
    as_of: int | None = None
    order: tuple[str, bool] | None = None
    limit: int = 0


def time_nanos(text: str) -> int:
    """Nanoseconds of an RFC 3339 time (nine digits kept) or a plain date, UTC."""
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:T(\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2}))?", text)
    if not m:
        raise SyntaxProblem(f"no time: {text!r}")
    try:
        base = datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}{(m[4] or 'Z').replace('Z', '+00:00')}")
    except ValueError as e:
        raise SyntaxProblem(f"no time: {text!r}") from e
    return int((base - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 10**9 + int((m[3] or "").ljust(9, "0") or 0)


class _Reader:
    def __init__(self, text: str):
        self.rest = tokens(text)[::-1]

    def peek(self) -> str:
        return self.rest[-1].text.lower() if self.rest and self.rest[-1].kind == "word" else ""

    def mark(self, text: str) -> bool:
        if self.rest and self.rest[-1].kind == "mark" and self.rest[-1].text == text:
            self.rest.pop()
            return True
        return False

    def take(self, *kinds: str) -> Token:
        if not self.rest:
            raise SyntaxProblem(f"expected {' or '.join(kinds)} at the end")
        if self.rest[-1].kind not in kinds:
            raise SyntaxProblem(f"expected {' or '.join(kinds)}, got {self.rest[-1].text!r}")
        return self.rest.pop()

    def word(self, *allowed: str) -> str:
        t = self.take("word").text.lower()
        if t not in allowed:
            raise SyntaxProblem(f"expected {' or '.join(allowed)}, got {t!r}")
        return t

    def need(self, text: str) -> None:
        if not self.mark(text):
            raise SyntaxProblem(f"expected {text!r}")

    def condition(self) -> Condition:
        name = self.take("word").text
        while self.mark("."):
            name += "." + self.take("word").text
        t = self.take("mark", "word")
        op = t.text.lower()
        if op not in ("=", "!=", "<", "<=", ">", ">=", "contains", "matches"):
            raise SyntaxProblem(f"no operator: {t.text!r}")
        v = self.take("string", "number", "word")
        if v.kind == "word" and v.text.lower() not in ("true", "false"):
            raise SyntaxProblem(f"no value: {v.text!r}")
        return Condition(name, op, {"string": str, "number": float, "word": lambda x: x.lower() == "true"}[v.kind](v.text))

    def traverse(self) -> Traverse:
        self.word("traverse")
        self.need("(")
        edges, more = self.take("word").text, {}
        while self.mark(","):
            key = self.take("word").text.lower()
            self.need("=")
            if key == "depth":
                text = self.take("number").text
                if not text.isdigit():
                    raise SyntaxProblem(f"depth {text}")
                more["depth"] = int(text)
            elif key in ("edge", "type"):
                more["edge_type"] = self.take("string").text
            elif key == "direction":
                way = self.take("word", "string").text.lower()
                if way not in ("forward", "reverse", "both"):
                    raise SyntaxProblem(f"direction {way!r}")
                more["direction"] = way
            else:
                raise SyntaxProblem(f"unknown argument {key!r}")
        self.need(")")
        self.word("from")
        start = self.take("string").text
        if not start:
            raise SyntaxProblem("a traversal needs a start")
        return Traverse(edges, start, **more)


def parse(text: str) -> Query:
    """A query from its text."""
    r = _Reader(text)
    if not r.rest:
        raise SyntaxProblem("empty query")
    q = Query(r.take("word").text.lower())
    done: set[str] = set()
    while r.rest:
        clause = r.word("where", "as", "order", "limit")
        if clause in done:
            raise SyntaxProblem(f"{clause} twice")
        done.add(clause)
        if clause == "where":
            if r.peek() == "traverse":
                q.traverse = r.traverse()
                continue
            q.where = [[r.condition()]]
            while r.peek() in ("and", "or"):
                if r.word("and", "or") == "and":
                    q.where[-1].append(r.condition())
                else:
                    q.where.append([r.condition()])
        elif clause == "as":
            r.word("of")
            q.as_of = time_nanos(r.take("string").text)
        elif clause == "order":
            r.word("by")
            name = r.take("word").text
            while r.mark("."):
                name += "." + r.take("word").text
            down = r.peek() in ("asc", "desc") and r.word("asc", "desc") == "desc"
            q.order = (name, down)
        else:
            n = r.take("number").text
            if not n.isdigit() or int(n) < 1:
                raise SyntaxProblem(f"limit {n}")
            q.limit = int(n)
    return q


_ALLOWED = {"=": None, "!=": None, "contains": {"string", "time", "[]string"}, "matches": {"string", "time"}} | dict.fromkeys(("<", "<=", ">", ">="), {"number", "time"})


def check(q: Query, registry: Registry) -> None:
    """Raises what is wrong with a query's names and operators."""
    fields = registry.fields(q.collection)
    if fields is None:
        raise UnknownCollection(q.collection)
    for c in (c for group in q.where for c in group):
        if c.field not in fields:
            raise UnknownField(f"{c.field} in {q.collection}")
        kinds = _ALLOWED[c.op]
        if kinds is not None and fields[c.field] not in kinds:
            raise IncompatibleOperator(f"{c.op} on {fields[c.field]} field {c.field}")
    names = {*fields, *({"id", "ref"} if q.traverse else ())}
    if q.order and q.order[0] not in names:
        raise UnknownField(f"{q.order[0]} in {q.collection}")


#: What RE2 lacks: look-around, back-references, possessive and atomic groups.
_NOT_RE2 = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|[*+?}]\+")


def _matches(c: Column, pattern: str) -> Column:
    """Unanchored match; a pattern that RE2 would refuse matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.lit(False) if _NOT_RE2.search(pattern) else c.rlike(pattern)


def _text(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _compare(c: Condition, kind: str) -> Column:
    col = F.col(f"`{c.field}`")
    if c.op == "contains":
        return F.array_contains(col, _text(c.value)) if kind == "[]string" else col.contains(_text(c.value))
    if c.op == "matches":
        return _matches(col, _text(c.value))
    if kind == "number" and isinstance(c.value, float):
        value = F.lit(c.value)
    elif kind == "bool" and isinstance(c.value, bool):
        value = F.lit(c.value)
    else:
        col, value = col.cast("string"), F.lit(_text(c.value))
    return {"=": col == value, "!=": col != value, "<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value}[c.op]


def predicate(q: Query, registry: Registry) -> Column | None:
    """The conditions as one Column that Catalyst can push into the scan."""
    fields = registry.fields(q.collection)
    groups = [reduce(lambda a, b: a & b, [_compare(c, fields[c.field]) for c in g]) for g in q.where]
    return reduce(lambda a, b: a | b, groups) if groups else None


def compile_query(q: Query, table: DataFrame | None, links: DataFrame | None = None, registry: Registry | None = None, key: str = "id") -> DataFrame:
    """The DataFrame of a checked query.

    ``table`` is the collection; ``links`` serve a traversal.  With ``as of``, a
    table with ``version`` and ``created_at_nanos`` is first brought to that time.
    """
    registry = registry or Registry()
    check(q, registry)
    if q.traverse:
        t = q.traverse
        spark = links.sparkSession
        start = spark.createDataFrame([(t.start,)], "ref string")
        out = reachable(links, start, t.depth or DEFAULT_DEPTH, t.direction, [t.edge_type] if t.edge_type else None, q.as_of, VISITED_CAP)
        out = out.select(F.coalesce(split_ref(F.col("ref"))["id"], F.col("ref")).alias("id"), "ref")
        order = q.order or ("ref", False)
        out = out.orderBy(F.col(order[0]).desc() if order[1] else F.col(order[0]).asc())
        return out.limit(q.limit) if q.limit else out
    out = table
    if q.as_of is not None:
        if not {"version", "created_at_nanos"} <= set(table.columns):
            raise QueryError("AS OF needs TRAVERSE or a versioned collection")
        out = as_of_highest(table, q.as_of, [key])
    where = predicate(q, registry)
    out = out.where(where) if where is not None else out
    if q.order:
        c = F.col(f"`{q.order[0]}`")
        out = out.orderBy(c.desc_nulls_last() if q.order[1] else c.asc_nulls_first(), key)
    return out.limit(q.limit) if q.limit else out


def wanted(q: Query, registry: Registry) -> list[dict[str, list[str]]]:
    """What rows must have to satisfy a query, by alternative and field, where an index of the field can tell.

    Equality of texts and membership in arrays can be looked up.  With ``as of``
    nothing can: a row's field may have had another value then.
    """
    fields = registry.fields(q.collection)
    if q.as_of is not None or q.traverse:
        return []
    served = lambda c: c.op == "=" and fields[c.field] in ("string", "time") or c.op == "contains" and fields[c.field] == "[]string"
    out = []
    for group in q.where:
        own: dict[str, list[str]] = {}
        for c in filter(served, group):
            own.setdefault(c.field, [_text(c.value)])
        out.append(own)
    return out


def over_store(q: Query, store: Store) -> tuple[DataFrame, Seek | None]:
    """A query's rows from a store's collection, and what its indexes spared.

    Files that no index names for the query's conditions are not read; the
    conditions themselves go into the scan of the others.
    """
    registry = store.registry()
    check(q, registry)
    table, seek = store.seek(q.collection, wanted(q, registry))
    return compile_query(q, table, registry=registry), seek


def run(text: str, table: DataFrame | None, links: DataFrame | None = None, registry: Registry | None = None) -> DataFrame:
    """The DataFrame of a query's text."""
    return compile_query(parse(text), table, links, registry)


def explain(q: Query, read: Seek | None = None) -> str:
    """What a query does, one line for each part; with ``read``, also the files that it comes to."""
    conditions = [c for g in q.where for c in g]
    served = INDEXED.get(q.collection, {})
    seek = next((c for c in conditions if c.op == "=" and c.field in served), None) if len(q.where) == 1 else None
    ranged = len(q.where) == 1 and any(c.op in ("<", "<=", ">", ">=") and c.field in served for c in conditions)
    lines = [("Collection", q.collection), ("Strategy", "IndexSeek" if seek else "RangeScan" if ranged else "FullScan")]
    if seek:
        lines += [("Index", served[seek.field]), ("Seek key", _text(seek.value))]
    if conditions:
        lines.append(("Filters", " OR ".join(" AND ".join(f"{c.field} {c.op} {_text(c.value)}" for c in g) for g in q.where)))
    if q.order:
        lines.append(("Order by", f"{q.order[0]} {'DESC' if q.order[1] else 'ASC'}"))
    if q.limit:
        lines.append(("Limit", str(q.limit)))
    if read:
        lines.append(("Files", f"{len(read.files)} of {read.of} by {', '.join(read.fields)}"))
    return "\n".join(f"{name + ':':<12}{value}" for name, value in lines)
