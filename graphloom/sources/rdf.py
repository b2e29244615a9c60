"""Readers and writers of RDF. A graph is a DataFrame (s, p, o, o_kind, dt, lang) without repeated rows.

N-Triples and tab-separated triples are read and written line by line by executors. Turtle and RDF/XML can't be split, so
each file is parsed whole by one task; they are for ontologies and other small files. Line formats serve for data.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF, XSD

TRIPLE = "s string, p string, o string, o_kind string, dt string, lang string"
COLUMNS = ["s", "p", "o", "o_kind", "dt", "lang"]

_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def _unescape(c: Column) -> Column:
    """N-Triples escapes undone; the doubled backslash last, by way of a mark."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\u0001"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(out, F.lit("\u0001"), F.lit("\\"))


def _escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """All triples of N-Triples files; lines that are none are skipped."""
    parts = spark.read.text(path).select(*(F.regexp_extract("value", _NT, i).alias(x) for i, x in ((1, "s"), (2, "p"), (3, "t")))).filter("s <> ''")
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    literal = F.col("t").startswith('"')
    text = F.regexp_extract("t", r'^"((?:[^"\\]|\\.)*)"', 1)
    none = lambda c: F.when(c != "", c)
    return parts.select(
        bare(F.col("s")).alias("s"), "p", F.when(literal, _unescape(text)).otherwise(bare(F.col("t"))).alias("o"),
        F.when(literal, F.lit("literal")).when(F.col("t").startswith("_:"), F.lit("bnode")).otherwise(F.lit("uri")).alias("o_kind"),
        F.when(literal, none(F.regexp_extract("t", r"\^\^<([^>]*)>$", 1))).alias("dt"), F.when(literal, none(F.regexp_extract("t", r'"@([A-Za-z0-9-]+)$', 1))).alias("lang"),
    ).distinct()


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of the triples between IRIs; lines with literals and blank nodes are skipped."""
    r = r"^<([^>]+)>\s+<([^>]+)>\s+<([^>]+)>\s*\.\s*$"
    return spark.read.text(path).select(*(F.regexp_extract("value", r, i).alias(x) for i, x in ((1, "s"), (2, "p"), (3, "o")))).filter("s <> ''")


def ntriples_lines(triples: DataFrame) -> DataFrame:
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    literal = F.concat(F.lit('"'), _escape(F.col("o")), F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("dt").isNotNull(), F.concat(F.lit("^^<"), F.col("dt"), F.lit(">"))).otherwise(F.lit("")))
    return triples.select(F.concat(node("s"), F.lit(" <"), F.col("p"), F.lit("> "), F.when(F.col("o_kind") == "literal", literal).otherwise(node("o")), F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of the lines that have exactly three fields."""
    return spark.read.text(path).select(F.split("value", "\t").alias("x")).filter(F.size("x") == 3).select(*(F.col("x")[i].alias(c) for i, c in enumerate("spo")))


def write_tsv(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws("\t", "s", "p", "o").alias("value")).write.mode("overwrite").text(path)


_TTL = re.compile(
    r"""(?P<ws>(?:\s+|\#[^\n]*)+)|(?P<iri><[^<>"\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[a-zA-Z][a-zA-Z0-9-]*)|(?P<dt>\^\^)|(?P<num>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?))(?![\w:])|(?P<bnode>_:[\w.-]*\w)"""
    r"""|(?P<name>(?:[\w][\w.-]*)?:(?:[\w%\-:](?:(?:[\w%\-:]|\\.|\.(?=[\w%\-:\\]))*))?|a(?![\w:])|true\b|false\b|prefix\b|base\b)|(?P<punct>[.;,\[\]()])""",
    re.X | re.I,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\", "b": "\b", "f": "\f"}


def _text(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s, flags=re.S)


class _Turtle:
    """A recursive-descent reader of one Turtle text."""

    def __init__(self, text: str, label: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TTL.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"Turtle: can't read {text[at : at + 30]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup or "", m.group()))
            at = m.end()
        self.at, self.prefixes, self.base, self.label, self.blanks = 0, {}, "", label, 0
        self.out: list[tuple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("", "")

    def take(self, want: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if want is not None and t[1] != want:
            raise ValueError(f"Turtle: expected {want!r}, found {t[1]!r}")
        self.at += 1
        return t

    def blank(self) -> str:
        self.blanks += 1
        return f"_:{self.label}b{self.blanks}"

    def read(self) -> list[tuple]:
        while self.at < len(self.tokens):
            kind, t = self.peek()
            word = t.lower()
            if word in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.iri(self.take()[1])
                if word[0] == "@":
                    self.take(".")
            elif word in ("@base", "base"):
                self.take()
                self.base = self.take()[1][1:-1]
                if word[0] == "@":
                    self.take(".")
            else:
                alone = t == "["
                s = self.term()[0]
                if not (alone and self.peek()[1] == "."):
                    self.properties(s)
                self.take(".")
        return self.out

    def iri(self, t: str) -> str:
        iri = _text(t[1:-1])
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else self.base + iri

    def name(self, t: str) -> str:
        p, _, local = t.partition(":")
        if p not in self.prefixes:
            raise ValueError(f"Turtle: unknown prefix {p!r}")
        return self.prefixes[p] + re.sub(r"\\(.)", r"\1", local)

    def properties(self, s: str) -> None:
        while True:
            kind, t = self.take()
            p = RDF + "type" if t == "a" else self.iri(t) if kind == "iri" else self.name(t)
            while True:
                self.out.append((s, p, *self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", ""):
                return

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, t = self.take()
        if kind == "iri":
            return self.iri(t), "uri", None, None
        if kind == "bnode":
            return f"_:{self.label}{t[2:]}", "bnode", None, None
        if t == "[":
            b = self.blank()
            if self.peek()[1] != "]":
                self.properties(b)
            self.take("]")
            return b, "bnode", None, None
        if t == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            head = RDF + "nil"
            for item in reversed(items):
                b = self.blank()
                self.out.append((b, RDF + "first", *item))
                self.out.append((b, RDF + "rest", head, "uri" if head.endswith("nil") else "bnode", None, None))
                head = b
            return head, "uri" if head.endswith("#nil") else "bnode", None, None
        if kind in ("str", "long"):
            s = _text(t[3:-3] if kind == "long" else t[1:-1])
            if self.peek()[0] == "lang":
                return s, "literal", None, self.take()[1][1:]
            if self.peek()[0] == "dt":
                self.take()
                k, d = self.take()
                return s, "literal", self.iri(d) if k == "iri" else self.name(d), None
            return s, "literal", None, None
        if kind == "num":
            return t, "literal", XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"), None
        if t in ("true", "false"):
            return t, "literal", XSD + "boolean", None
        if kind == "name":
            return self.name(t), "uri", None, None
        raise ValueError(f"Turtle: unexpected {t!r}")


def parse_turtle(text: str, label: str = "") -> list[tuple]:
    """The triples of a Turtle text; blank nodes are named after ``label``."""
    return _Turtle(text, label).read()


def parse_rdfxml(text: str, label: str = "") -> list[tuple]:
    """The triples of an RDF/XML text: typed nodes, property elements and attributes, nested nodes, collections."""
    rdf = f"{{{RDF}}}"
    out: list[tuple] = []
    blanks = 0
    root = ET.fromstring(text)
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")
    full = lambda tag: tag[1:].replace("}", "")
    resolve = lambda x: x if re.match(r"[A-Za-z][\w+.-]*:", x) else base.rstrip("#") + x if x.startswith("#") else base + x

    def fresh() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:{label}x{blanks}"

    def node(e: ET.Element) -> tuple[str, str]:
        if (about := e.get(rdf + "about")) is not None:
            s = resolve(about)
        elif (i := e.get(rdf + "ID")) is not None:
            s = base + "#" + i
        elif (b := e.get(rdf + "nodeID")) is not None:
            s = f"_:{label}{b}"
        else:
            s = fresh()
        if e.tag != rdf + "Description":
            out.append((s, RDF + "type", full(e.tag), "uri", None, None))
        for k, v in e.attrib.items():
            if not k.startswith(rdf) and "XML/1998" not in k:
                out.append((s, full(k), v, "literal", None, None))
        for p in e:
            prop = full(p.tag)
            if (r := p.get(rdf + "resource")) is not None:
                out.append((s, prop, resolve(r), "uri", None, None))
            elif (b := p.get(rdf + "nodeID")) is not None:
                out.append((s, prop, f"_:{label}{b}", "bnode", None, None))
            elif p.get(rdf + "parseType") == "Collection":
                head, kind = RDF + "nil", "uri"
                for item in reversed([node(c) for c in p]):
                    cell = fresh()
                    out.append((cell, RDF + "first", *item, None, None))
                    out.append((cell, RDF + "rest", head, kind, None, None))
                    head, kind = cell, "bnode"
                out.append((s, prop, head, kind, None, None))
            elif p.get(rdf + "parseType") == "Resource" or len(p):
                out.append((s, prop, *node(p[0]), None, None) if len(p) else (s, prop, fresh(), "bnode", None, None))
            else:
                out.append((s, prop, p.text or "", "literal", p.get(rdf + "datatype"), p.get("{http://www.w3.org/XML/1998/namespace}lang")))
        return s, "bnode" if s.startswith("_:") else "uri"

    for e in root:
        node(e)
    return out


def _whole_files(spark: SparkSession, paths: list[str], parse) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(parse(bytes(content).decode("utf-8"), "f" + hashlib.md5(path.encode()).hexdigest()[:8]), columns=COLUMNS)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, TRIPLE).distinct()


def read_turtle(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of Turtle files as one graph."""
    return _whole_files(spark, list(paths), parse_turtle)


def read_rdfxml(spark: SparkSession, *paths: str) -> DataFrame:
    return _whole_files(spark, list(paths), parse_rdfxml)


def turtle_lines(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(s, value): a block of Turtle for each subject, with prefixed names where they are safe."""
    def short(c: Column) -> Column:
        out = F.concat(F.lit("<"), c, F.lit(">"))
        for k, v in sorted(prefixes.items(), key=lambda x: len(x[1])):
            rest = F.substring(c, len(v) + 1, 1_000_000)
            out = F.when(c.startswith(v) & rest.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(k + ":"), rest)).otherwise(out)
        return F.when(c.startswith("_:"), c).otherwise(out)

    quoted = F.concat(F.lit('"'), _escape(F.col("o")), F.lit('"'))
    literal = F.when(F.col("lang").isNotNull(), F.concat(quoted, F.lit("@"), F.col("lang"))).when(F.col("dt").isNotNull(), F.concat(quoted, F.lit("^^"), short(F.col("dt")))).otherwise(quoted)
    p = F.when(F.col("p") == RDF + "type", F.lit("a")).otherwise(short(F.col("p")))
    line = F.concat(p, F.lit(" "), F.when(F.col("o_kind") == "literal", literal).otherwise(short(F.col("o"))))
    return triples.select("s", line.alias("line")).groupBy("s").agg(F.array_sort(F.collect_set("line")).alias("lines")).select("s", F.concat(short(F.col("s")), F.lit(" "), F.array_join("lines", " ;\n    "), F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """Turtle parts; each starts with the prefixes, so that it can be read alone."""
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in sorted(prefixes.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for pdf in batches:
            yield pd.DataFrame({"value": [head, *pdf["value"]] if first else list(pdf["value"])})
            first = False

    turtle_lines(triples, prefixes).select("value").mapInPandas(run, "value string").write.mode("overwrite").text(path)


def rdfxml_text(triples: DataFrame) -> str:
    """RDF/XML of a small graph (an ontology), made on the driver from at most 100,000 triples."""
    from xml.sax.saxutils import escape, quoteattr

    rows = triples.orderBy("s", "p", "o").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("RDF/XML is for small graphs; write N-Triples")
    spaces: dict[str, str] = {}
    out, last = [], None
    for r in rows:
        m = re.match(r"(.*[#/])([A-Za-z_][\w.-]*)$", r["p"])
        if not m:
            raise ValueError(f"no XML name for {r['p']}")
        ns = spaces.setdefault(m[1], f"n{len(spaces)}")
        if r["s"] != last:
            out += ["</rdf:Description>"] * (last is not None) + [f"<rdf:Description {'rdf:nodeID' if r['s'].startswith('_:') else 'rdf:about'}={quoteattr(r['s'].removeprefix('_:'))}>"]
            last = r["s"]
        tag = f"{ns}:{m[2]}"
        if r["o_kind"] == "uri":
            out.append(f"<{tag} rdf:resource={quoteattr(r['o'])}/>")
        elif r["o_kind"] == "bnode":
            out.append(f"<{tag} rdf:nodeID={quoteattr(r['o'].removeprefix('_:'))}/>")
        else:
            more = f" rdf:datatype={quoteattr(r['dt'])}" if r["dt"] else f" xml:lang={quoteattr(r['lang'])}" if r["lang"] else ""
            out.append(f"<{tag}{more}>{escape(r['o'])}</{tag}>")
    out += ["</rdf:Description>"] * (last is not None)
    return f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}" ' + " ".join(f"xmlns:{v}={quoteattr(k)}" for k, v in spaces.items()) + ">\n" + "\n".join(out) + "\n</rdf:RDF>\n"
