"""A practical subset of SPARQL 1.1, compiled to DataFrame plans.

Text becomes tokens, then a tree of groups (triple patterns, OPTIONAL, UNION, FILTER), then joins of scans of the triple
table, each filtered by the constants of its pattern so that they reach the source. Patterns are ordered so that
joins share variables and the most selective come first; a pattern group without shared variables is refused rather than
run as a product. Catalyst picks the joins. Everything is checked before a job runs.

SELECT [DISTINCT], ASK and CONSTRUCT; PREFIX, BASE; ``a``, ``;``, ``,``; FILTER with comparisons, &&, ||, !, IN, NOT IN
and the functions of ``_FUNCTIONS``; ORDER BY, LIMIT, OFFSET. SERVICE, DESCRIBE, sub-selects, paths and aggregates raise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import OWL, RDF, RDFS, XSD


class SparqlError(ValueError):
    """The query can't be read or isn't supported."""


Term = tuple  # ("var", name) | ("uri", iri) | ("literal", text, dt, lang)

_LEX = re.compile(
    r"""(?P<ws>(?:\s+|\#[^\n]*)+)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>\"{3}.*?\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?P<tail>@[a-zA-Z][\w-]*|\^\^(?:<[^<>\s]*>|[\w.-]*:[\w.-]+))?"""
    r"""|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w.-]*:(?:[\w%-](?:[\w.%-]*[\w%-])?)?|:[\w%-]+)|(?P<word>[A-Za-z_]\w*)|(?P<op>&&|\|\||!=|<=|>=|[{}().;,=<>!*+\-/\[\]|^])""",
    re.X | re.S,
)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise SparqlError(f"can't read the query at {text[at : at + 30]!r}")
        if m.group("ws") is None:
            kind = "str" if m.group("str") is not None else m.lastgroup or ""
            out.append((kind, m.group()))
        at = m.end()
    return out


@dataclass
class Group:
    patterns: list[tuple[Term, Term, Term]] = field(default_factory=list)
    parts: list[tuple[str, object]] = field(default_factory=list)  # ("optional", Group) | ("union", [Group]) | ("group", Group)
    filters: list[tuple] = field(default_factory=list)


@dataclass
class Query:
    form: str
    variables: list[str] | None
    where: Group
    distinct: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    template: list[tuple[Term, Term, Term]] = field(default_factory=list)


#: Functions of filters: name -> number of arguments (least, most).
_FUNCTIONS = {
    "BOUND": (1, 1), "ISBLANK": (1, 1), "ISIRI": (1, 1), "ISURI": (1, 1), "ISLITERAL": (1, 1), "LANG": (1, 1), "DATATYPE": (1, 1), "STR": (1, 1), "LCASE": (1, 1), "UCASE": (1, 1), "STRLEN": (1, 1),
    "CONTAINS": (2, 2), "STRSTARTS": (2, 2), "STRENDS": (2, 2), "REGEX": (2, 3), "LANGMATCHES": (2, 2), "SAMETERM": (2, 2), "ABS": (1, 1),
}


class _Parser:
    def __init__(self, text: str, prefixes: dict[str, str]):
        self.ts, self.at = tokens(text), 0
        self.prefixes = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL} | prefixes
        self.base = ""

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.ts[self.at + ahead] if self.at + ahead < len(self.ts) else ("", "")

    def word(self) -> str:
        k, t = self.peek()
        return t.upper() if k == "word" else t

    def take(self, want: str | None = None) -> tuple[str, str]:
        k, t = self.peek()
        if want is not None and self.word() != want:
            raise SparqlError(f"expected {want}, found {t or 'the end'}")
        if not k:
            raise SparqlError("the query ends too early")
        self.at += 1
        return k, t

    def query(self) -> Query:
        while self.word() in ("PREFIX", "BASE"):
            if self.take()[1].upper() == "BASE":
                self.base = self.take()[1][1:-1]
                continue
            k, name = self.take()
            if k == "op" and name == ":":
                name = ":"
            if not name.endswith(":"):
                raise SparqlError(f"no prefix: {name}")
            k, iri = self.take()
            if k != "iri":
                raise SparqlError(f"no IRI for the prefix {name}")
            self.prefixes[name[:-1]] = iri[1:-1]
        form = self.take()[1].upper()
        if form == "SELECT":
            q = self.select()
        elif form == "ASK":
            q = Query("ASK", [], self.where())
        elif form == "CONSTRUCT":
            template = Group()
            self.take("{")
            self.triples(template)
            self.take("}")
            q = Query("CONSTRUCT", [], self.where(), template=template.patterns)
        else:
            raise SparqlError(f"{form} isn't supported")
        self.modifiers(q)
        if self.peek()[0]:
            raise SparqlError(f"unexpected {self.peek()[1]}")
        return q

    def select(self) -> Query:
        distinct = self.word() in ("DISTINCT", "REDUCED")
        if distinct:
            distinct = self.take()[1].upper() == "DISTINCT"
        if self.word() == "*":
            self.take()
            return Query("SELECT", None, self.where(), distinct)
        names = []
        while self.peek()[0] == "var":
            names.append(self.take()[1][1:])
        if not names:
            raise SparqlError(f"SELECT needs variables, found {self.peek()[1]}")
        return Query("SELECT", names, self.where(), distinct)

    def where(self) -> Group:
        if self.word() == "WHERE":
            self.take()
        return self.group()

    def modifiers(self, q: Query) -> None:
        if self.word() == "ORDER":
            self.take()
            self.take("BY")
            while self.peek()[0] == "var" or self.word() in ("ASC", "DESC"):
                if self.peek()[0] == "var":
                    q.order.append((self.take()[1][1:], True))
                else:
                    up = self.take()[1].upper() == "ASC"
                    self.take("(")
                    k, v = self.take()
                    if k != "var":
                        raise SparqlError("ORDER BY takes variables")
                    q.order.append((v[1:], up))
                    self.take(")")
            if not q.order:
                raise SparqlError("ORDER BY takes variables")
        while self.word() in ("LIMIT", "OFFSET"):
            which = self.take()[1].upper()
            k, n = self.take()
            if k != "num" or not n.isdigit():
                raise SparqlError(f"{which} takes a number")
            if which == "LIMIT":
                q.limit = int(n)
            else:
                q.offset = int(n)

    def group(self) -> Group:
        self.take("{")
        g = Group()
        while self.word() != "}":
            w = self.word()
            if w == "OPTIONAL":
                self.take()
                g.parts.append(("optional", self.group()))
            elif w == "FILTER":
                self.take()
                g.filters.append(self.constraint())
            elif w == "{":
                some = [self.group()]
                while self.word() == "UNION":
                    self.take()
                    some.append(self.group())
                g.parts.append(("union", some) if len(some) > 1 else ("group", some[0]))
            elif w in ("SERVICE", "GRAPH", "MINUS", "BIND", "VALUES", "SELECT"):
                raise SparqlError(f"{w} isn't supported")
            elif w == ".":
                self.take()
            else:
                self.triples(g)
        self.take("}")
        return g

    def triples(self, g: Group) -> None:
        while self.peek()[0] in ("var", "iri", "name", "str", "num"):
            s = self.term()
            if s[0] == "literal":
                raise SparqlError("a literal can't be a subject")
            while True:
                p = ("uri", RDF + "type") if self.peek() == ("word", "a") and self.take() else self.term()
                if p[0] == "literal":
                    raise SparqlError("a literal can't be a property")
                if self.word() in ("/", "|", "^", "*", "+"):
                    raise SparqlError("property paths aren't supported")
                while True:
                    g.patterns.append((s, p, self.term()))
                    if self.word() != ",":
                        break
                    self.take()
                if self.word() != ";":
                    break
                while self.word() == ";":
                    self.take()
                if self.word() in (".", "}"):
                    break
            if self.word() == ".":
                self.take()
            elif self.peek()[0] in ("var", "iri", "name", "str", "num"):
                raise SparqlError(f"a full stop is missing before {self.peek()[1]}")
        if self.word() not in ("}", "OPTIONAL", "FILTER", "{", ".", "SERVICE", "GRAPH", "MINUS", "BIND", "VALUES", "SELECT"):
            raise SparqlError(f"unexpected {self.peek()[1] or 'end'}")

    def name(self, t: str) -> str:
        p, _, local = t.partition(":")
        if p not in self.prefixes:
            raise SparqlError(f"unknown prefix {p}:")
        return self.prefixes[p] + local

    def term(self) -> Term:
        k, t = self.take()
        if k == "var":
            return "var", t[1:]
        if k == "iri":
            return "uri", t[1:-1] if re.match(r"[A-Za-z][\w+.-]*:", t[1:-1]) else self.base + t[1:-1]
        if k == "name":
            return "uri", self.name(t)
        if k == "num":
            return "literal", t, XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"), None
        if k == "op" and t == "-" and self.peek()[0] == "num":
            x = self.term()
            return "literal", "-" + x[1], x[2], None
        if k == "word" and t.lower() in ("true", "false"):
            return "literal", t.lower(), XSD + "boolean", None
        if k == "str":
            m = re.match(r"(\"{3}.*\"{3}|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')(.*)$", t, re.S)
            body, tail = m.group(1), m.group(2)
            body = body[3:-3] if body.startswith('"""') else body[1:-1]
            body = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), body)
            if tail.startswith("@"):
                return "literal", body, None, tail[1:].lower()
            if tail:
                d = tail[2:]
                return "literal", body, d[1:-1] if d[0] == "<" else self.name(d), None
            return "literal", body, None, None
        raise SparqlError(f"a term was expected, found {t}")

    def constraint(self) -> tuple:
        if self.word() != "(" and not (self.peek()[0] == "word" and self.word() in _FUNCTIONS):
            raise SparqlError(f"FILTER takes an expression, found {self.peek()[1]}")
        return self.primary()

    def expression(self) -> tuple:
        out = self.conjunction()
        while self.word() == "||":
            self.take()
            out = ("or", out, self.conjunction())
        return out

    def conjunction(self) -> tuple:
        out = self.relation()
        while self.word() == "&&":
            self.take()
            out = ("and", out, self.relation())
        return out

    def relation(self) -> tuple:
        a = self.primary()
        w = self.word()
        if w in ("=", "!=", "<", ">", "<=", ">="):
            self.take()
            return w, a, self.primary()
        if w == "IN" or (w == "NOT" and self.peek(1)[1].upper() == "IN"):
            if self.take()[1].upper() == "NOT":
                self.take("IN")
            self.take("(")
            items = []
            while self.word() != ")":
                items.append(self.expression())
                if self.word() == ",":
                    self.take()
            self.take(")")
            return ("in" if w == "IN" else "not in"), a, items
        return a

    def primary(self) -> tuple:
        w = self.word()
        if w == "!":
            self.take()
            return "not", self.primary()
        if w == "(":
            self.take()
            out = self.expression()
            self.take(")")
            return out
        if self.peek()[0] == "word" and w not in ("TRUE", "FALSE"):
            self.take()
            if w not in _FUNCTIONS:
                raise SparqlError(f"the function {w} isn't supported")
            self.take("(")
            args = []
            while self.word() != ")":
                args.append(self.expression())
                if self.word() == ",":
                    self.take()
            self.take(")")
            if not _FUNCTIONS[w][0] <= len(args) <= _FUNCTIONS[w][1]:
                raise SparqlError(f"{w} takes {_FUNCTIONS[w][0]} arguments")
            return "call", w, args
        return "term", self.term()


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return _Parser(text, prefixes or {}).query()


# A term is one string in a plan, so that a join compares one column: U/B + IRI, or L + type + language + text.
_MARK = "\u0001"


def _encode(value: Column, kind: Column, dt: Column, lang: Column) -> Column:
    literal = F.concat(F.lit("L" + _MARK), F.coalesce(dt, F.lit("")), F.lit(_MARK), F.lower(F.coalesce(lang, F.lit(""))), F.lit(_MARK), value)
    return F.when(kind == "literal", literal).when(kind == "bnode", F.concat(F.lit("B" + _MARK), value)).otherwise(F.concat(F.lit("U" + _MARK), value))


def _node(c: Column) -> Column:
    return F.concat(F.when(c.startswith("_:"), F.lit("B" + _MARK)).otherwise(F.lit("U" + _MARK)), c)


def _part(c: Column, i: int) -> Column:
    return F.split(c, _MARK, 4)[i]


def _is(c: Column, kind: str) -> Column:
    return c.startswith(kind + _MARK)


def _text(c: Column) -> Column:
    return F.when(_is(c, "L"), _part(c, 3)).otherwise(F.substring(c, 3, 1_000_000_000))


def _constant(t: Term) -> Column:
    if t[0] == "uri":
        return F.lit("U" + _MARK + t[1])
    return F.lit("L" + _MARK + (t[2] or "") + _MARK + (t[3] or "") + _MARK + t[1])


def _vars(t: tuple) -> set[str]:
    return {t[1]} if t[0] == "var" else set()


def _expression_vars(e: object) -> set[str]:
    if isinstance(e, list):
        return set().union(*map(_expression_vars, e)) if e else set()
    if isinstance(e, tuple):
        if e and e[0] == "term":
            return _vars(e[1])
        return set().union(*(_expression_vars(x) for x in e)) if e else set()
    return set()


class _Compiler:
    def __init__(self, triples: DataFrame):
        self.triples = triples

    def scan(self, pattern: tuple[Term, Term, Term]) -> DataFrame:
        df = self.triples
        s, p, o = pattern
        if s[0] == "uri":
            df = df.filter(F.col("s") == s[1])
        if p[0] == "uri":
            df = df.filter(F.col("p") == p[1])
        if o[0] == "uri":
            df = df.filter((F.col("o") == o[1]) & (F.col("o_kind") == "uri"))
        elif o[0] == "literal":
            df = df.filter((F.col("o") == o[1]) & (F.col("o_kind") == "literal") & F.col("dt").eqNullSafe(F.lit(o[2])) & F.lower(F.col("lang")).eqNullSafe(F.lit(o[3])))
        cols: dict[str, Column] = {}
        same = []
        for t, c in ((s, _node(F.col("s"))), (p, _node(F.col("p"))), (o, _encode(F.col("o"), F.col("o_kind"), F.col("dt"), F.col("lang")))):
            if t[0] == "var":
                if t[1] in cols:
                    same.append(cols[t[1]] == c)
                else:
                    cols[t[1]] = c
        if same:
            df = df.filter(reduce(lambda a, b: a & b, same))
        return df.select(*(c.alias(v) for v, c in cols.items())) if cols else df.select(F.lit(1).alias("_one"))

    def bgp(self, patterns: list[tuple[Term, Term, Term]]) -> tuple[DataFrame, set[str]]:
        """Patterns joined in an order in which each shares a variable with those before it, constants first."""
        weight = lambda t: (t[0][0] != "var") * 4 + (t[2][0] != "var") * 3 + (t[1][0] != "var") - (t[1] == ("uri", RDF + "type"))
        left = sorted(patterns, key=weight, reverse=True)
        first = left.pop(0)
        df, bound = self.scan(first), set().union(*map(_vars, first))
        while left:
            linked = [t for t in left if bound & set().union(*map(_vars, t))] or [t for t in left if not set().union(*map(_vars, t))]
            if not linked:
                raise SparqlError("patterns without a common variable would be a product")
            t = max(linked, key=weight)
            left.remove(t)
            more = set().union(*map(_vars, t))
            if more:
                df = df.join(self.scan(t), sorted(bound & more))
            else:
                df = df.join(F.broadcast(self.scan(t).limit(1).select(F.lit(1).alias("_yes"))), F.lit(True), "left_semi")
            bound |= more
        return df.drop("_one") if bound else df, bound

    def group(self, g: Group) -> tuple[DataFrame, set[str], set[str]]:
        """(solutions, variables, those of them that are always bound)."""
        df: DataFrame | None = None
        bound: set[str] = set()
        sure: set[str] = set()
        if g.patterns:
            df, bound = self.bgp(g.patterns)
            sure = set(bound)
        for kind, part in g.parts:
            if kind == "optional":
                if df is None:
                    raise SparqlError("OPTIONAL needs a pattern before it")
                inner = Group(part.patterns, part.parts, [])  # type: ignore[attr-defined]
                r, vs, s = self.group(inner)
                outside = [f for f in part.filters if not _expression_vars(f) <= vs]  # type: ignore[attr-defined]
                for f in part.filters:  # type: ignore[attr-defined]
                    if f not in outside:
                        r = r.filter(F.coalesce(self.boolean(f, vs), F.lit(False)))
                shared = bound & vs
                if not shared or not shared <= sure or not shared <= s:
                    raise SparqlError("OPTIONAL must share bound variables with what stands before it")
                if outside:
                    renamed = r.select(*(F.col(v).alias(f"_r_{v}" if v in shared else v) for v in sorted(vs)))
                    on = reduce(lambda a, b: a & b, [df[v] == renamed[f"_r_{v}"] for v in sorted(shared)])
                    for f in outside:
                        on = on & F.coalesce(self.boolean(f, bound | vs), F.lit(False))
                    df = df.join(renamed, on, "left").drop(*(f"_r_{v}" for v in shared))
                else:
                    df = df.join(r, sorted(shared), "left")
                bound |= vs
                continue
            if kind == "union":
                sides = [self.group(x) for x in part]  # type: ignore[union-attr]
                r = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x[0] for x in sides])
                vs, s = set().union(*(x[1] for x in sides)), set.intersection(*(x[2] for x in sides))
            else:
                r, vs, s = self.group(part)  # type: ignore[arg-type]
            if df is None:
                df = r
            else:
                shared = bound & vs
                if not shared or not shared <= sure or not shared <= s:
                    raise SparqlError("groups must share variables that are always bound")
                df = df.join(r, sorted(shared))
            bound |= vs
            sure |= s
        if df is None:
            raise SparqlError("an empty group")
        for f in g.filters:
            missing = _expression_vars(f) - bound
            if missing:
                raise SparqlError(f"FILTER uses unknown variables: {', '.join(sorted(missing))}")
            df = df.filter(F.coalesce(self.boolean(f, bound), F.lit(False)))
        return df, bound, sure

    def boolean(self, e: tuple, bound: set[str]) -> Column:
        k = e[0]
        if k == "and":
            return self.boolean(e[1], bound) & self.boolean(e[2], bound)
        if k == "or":
            return self.boolean(e[1], bound) | self.boolean(e[2], bound)
        if k == "not":
            return ~self.boolean(e[1], bound)
        if k in ("=", "!=", "<", ">", "<=", ">="):
            return self.compare(k, e[1], e[2], bound)
        if k in ("in", "not in"):
            found = reduce(lambda a, b: a | b, [self.compare("=", e[1], x, bound) for x in e[2]], F.lit(False))
            return found if k == "in" else ~found
        if k == "call":
            return self.call(e, bound)
        value = self.value(e, bound)
        return F.when(_is(value, "L"), (_part(value, 3) != "") & (_part(value, 3) != "false") & (_part(value, 3) != "0"))

    def value(self, e: tuple, bound: set[str]) -> Column:
        """An expression as an encoded term."""
        if e[0] == "term":
            t = e[1]
            if t[0] == "var":
                if t[1] not in bound:
                    raise SparqlError(f"unknown variable ?{t[1]}")
                return F.col(t[1])
            return _constant(t)
        if e[0] == "call" and e[1] in ("LANG", "STR", "LCASE", "UCASE", "DATATYPE", "STRLEN", "ABS"):
            a = self.value(e[2][0], bound)
            plain = lambda c: F.concat(F.lit(f"L{_MARK}{_MARK}{_MARK}"), c)
            if e[1] == "LANG":
                return F.when(_is(a, "L"), plain(_part(a, 2)))
            if e[1] == "DATATYPE":
                return F.when(_is(a, "L"), F.concat(F.lit("U" + _MARK), F.when(_part(a, 1) == "", F.lit(XSD + "string")).otherwise(_part(a, 1))))
            if e[1] == "STRLEN":
                return F.concat(F.lit(f"L{_MARK}{XSD}integer{_MARK}{_MARK}"), F.length(_text(a)).cast("string"))
            if e[1] == "ABS":
                return F.concat(F.lit(f"L{_MARK}{XSD}double{_MARK}{_MARK}"), F.abs(_text(a).try_cast("double")).cast("string"))
            return plain({"STR": lambda x: x, "LCASE": F.lower, "UCASE": F.upper}[e[1]](_text(a)))
        raise SparqlError(f"{e[0] if e[0] != 'call' else e[1]} isn't a value")

    def compare(self, op: str, a: tuple, b: tuple, bound: set[str]) -> Column:
        x, y = self.value(a, bound), self.value(b, bound)
        nx, ny = (F.when(_is(c, "L"), _part(c, 3).try_cast("double")) for c in (x, y))
        numeric = any(e[0] == "term" and e[1][0] == "literal" and (e[1][2] or "").rpartition("#")[2] in ("integer", "decimal", "double", "int", "float") for e in (a, b)) or any(e[0] == "call" and e[1] in ("STRLEN", "ABS") for e in (a, b))
        ops = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}
        if numeric:
            return ops[op](nx, ny)  # what isn't a number is null, so the row is dropped
        if op in ("=", "!="):
            equal = F.when(nx.isNotNull() & ny.isNotNull() & (_part(x, 1) != "") & (_part(y, 1) != ""), nx == ny).otherwise(x == y)
            return equal if op == "=" else ~equal
        both = _is(x, "L") & _is(y, "L")
        return F.when(both & nx.isNotNull() & ny.isNotNull(), ops[op](nx, ny)).when(both, ops[op](_part(x, 3), _part(y, 3)))

    def call(self, e: tuple, bound: set[str]) -> Column:
        name, args = e[1], e[2]
        if name == "BOUND":
            return self.value(args[0], bound).isNotNull()
        a = self.value(args[0], bound)
        if name == "ISBLANK":
            return _is(a, "B")
        if name in ("ISIRI", "ISURI"):
            return _is(a, "U")
        if name == "ISLITERAL":
            return _is(a, "L")
        if name not in ("CONTAINS", "STRSTARTS", "STRENDS", "REGEX", "LANGMATCHES", "SAMETERM"):
            raise SparqlError(f"{name} isn't a condition")
        b = self.value(args[1], bound)
        if name == "SAMETERM":
            return a == b
        x, y = _text(a), _text(b)
        if name == "REGEX":
            if args[1][0] != "term" or args[1][1][0] != "literal":
                raise SparqlError("REGEX takes a constant pattern")
            flags = args[2][1][1] if len(args) > 2 else ""
            return x.rlike(("(?i)" if "i" in flags else "") + args[1][1][1])
        if name == "LANGMATCHES":
            return F.when(y == "*", x != "").otherwise((F.lower(x) == F.lower(y)) | F.lower(x).startswith(F.concat(F.lower(y), F.lit("-"))))
        return {"CONTAINS": x.contains(y), "STRSTARTS": x.startswith(y), "STRENDS": x.endswith(y)}[name]


def run(triples: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The query's solutions, a string column for each variable (null where unbound); ASK gives one row ``ask``, CONSTRUCT triples."""
    q = parse(text, prefixes)
    df, bound, _ = _Compiler(triples).group(q.where)
    if q.form == "ASK":
        return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
    if q.form == "CONSTRUCT":
        return _constructed(df, q, bound)
    names = sorted(bound) if q.variables is None else q.variables
    out = df.select(*(F.col(v) if v in bound else F.lit(None).cast("string").alias(v) for v in names), *(F.col(v).alias(f"_o{i}") for i, (v, _) in enumerate(q.order) if v in bound))
    if q.distinct:
        out = out.select(*names).distinct()
    if q.order:
        keys = []
        for i, (v, up) in enumerate(q.order):
            if v not in bound:
                continue
            c = F.col(v) if q.distinct else F.col(f"_o{i}")
            for k in (F.when(_is(c, "L"), _part(c, 3).try_cast("double")), _text(c)):
                keys.append(k.asc_nulls_first() if up else k.desc_nulls_last())
        keys += [F.col(v).asc_nulls_first() for v in names]  # ties in one order
        out = out.orderBy(*keys)
    elif q.limit is not None or q.offset:
        out = out.orderBy(*(F.col(v).asc_nulls_first() for v in names))
    if q.offset:
        out = out.offset(q.offset)
    if q.limit is not None:
        out = out.limit(q.limit)
    return out.select(*(_text(F.col(v)).alias(v) for v in names))


def _constructed(df: DataFrame, q: Query, bound: set[str]) -> DataFrame:
    def term(t: Term) -> Column:
        if t[0] == "var":
            if t[1] not in bound:
                raise SparqlError(f"unknown variable ?{t[1]}")
            return F.col(t[1])
        return _constant(t)

    rows = df.select(F.explode(F.array(*(F.struct(*(term(x).alias(n) for x, n in zip(t, "spo", strict=True))) for t in q.template))).alias("t")).select("t.*").filter("s is not null and p is not null and o is not null")
    none = lambda c: F.when(_is(F.col("o"), "L") & (c != ""), c)
    return rows.filter(~_is(F.col("s"), "L") & _is(F.col("p"), "U")).select(
        _text(F.col("s")).alias("s"), _text(F.col("p")).alias("p"), _text(F.col("o")).alias("o"),
        F.when(_is(F.col("o"), "L"), F.lit("literal")).when(_is(F.col("o"), "B"), F.lit("bnode")).otherwise(F.lit("uri")).alias("o_kind"), none(_part(F.col("o"), 1)).alias("dt"), none(_part(F.col("o"), 2)).alias("lang"),
    ).distinct()


def run_or_empty(triples: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> list[dict]:
    """The solutions as dictionaries; none where the query can't be run."""
    try:
        return [r.asDict() for r in run(triples, text, prefixes).collect()]
    except SparqlError:
        return []


def schema_summary(triples: DataFrame, prefixes: dict[str, str], predicates: int = 80, classes: int = 40, sample: int = 20) -> DataFrame:
    """(part, term) rows that describe a graph to a model: its prefixes, properties, classes and a few triples, in a fixed order."""
    spark = triples.sparkSession
    ps = triples.select(F.col("p").alias("term")).distinct().orderBy("term").limit(predicates).select(F.lit("predicate").alias("part"), "term")
    cs = triples.filter(F.col("p") == RDF + "type").select(F.col("o").alias("term")).distinct().orderBy("term").limit(classes).select(F.lit("class").alias("part"), "term")
    ts = triples.select("s", "p", "o").distinct().orderBy("s", "p", "o").limit(sample).select(F.lit("triple").alias("part"), F.concat_ws(" ", "s", "p", "o").alias("term"))
    full = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": OWL} | prefixes
    xs = spark.createDataFrame([("prefix", f"PREFIX {k}: <{v}>") for k, v in sorted(full.items())], "part string, term string")
    return xs.unionByName(ps).unionByName(cs).unionByName(ts)
