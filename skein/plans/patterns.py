"""A read-only subset of graph-pattern queries, compiled to DataFrames.

``MATCH`` paths of labelled nodes and typed hops (``-[:R]->``, or the reified pair ``-[:FROM_R]->(:R)-[:TO_R]->``),
``WHERE`` with comparisons, CONTAINS, label tests, AND, OR, NOT and NOT EXISTS, ``RETURN`` with aliases, literals
and count, ``UNION ALL``, ``ORDER BY`` and ``LIMIT`` over the whole union, ``$parameters``. Anything else is an error
that says where.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that make a statement more than a read (fixed values).
BLOCKED = ("ALTER", "ATTACH", "CALL", "COPY", "CREATE", "DELETE", "DETACH", "DROP", "EXPORT", "IMPORT", "INSERT", "INSTALL", "LOAD", "MERGE", "REMOVE", "RENAME", "SET", "TRUNCATE", "UPDATE", "USE")
TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?)|(?P<param>\$\w+)|(?P<word>\w+)|(?P<mark><>|<=|>=|->|<-|[-()\[\]{}:,.=<>*]))""")


class PatternError(ValueError):
    """The statement is not in the subset, or not read-only."""


def check_read_only(statement: str) -> str:
    """The statement without closing semicolons; an error for several statements or a blocked word anywhere."""
    text = statement.strip().rstrip(";")
    if ";" in text:
        raise PatternError("one read-only statement at a time")
    for word in BLOCKED:
        if re.search(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", text, re.I | re.A):
            raise PatternError(f"blocked keyword: {word}")
    return text


class _Parser:
    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise PatternError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at, self.names = 0, 0

    def peek(self, *words: str) -> bool:
        """Whether the next tokens are these words (keywords in any case)."""
        ahead = self.items[self.at : self.at + len(words)]
        return len(ahead) == len(words) and all(v.upper() == w and k != "string" for (k, v), w in zip(ahead, words, strict=True))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise PatternError(f"expected {word} at {self.items[self.at][1] if self.at < len(self.items) else 'the end'!r}")

    def word(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "word":
            raise PatternError(f"expected a name at {self.items[self.at][1] if self.at < len(self.items) else 'the end'!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def node(self) -> dict:
        self.need("(")
        out = {"name": None, "label": None, "props": []}
        if self.items[self.at][0] == "word":
            out["name"] = self.word()
        if self.take(":"):
            out["label"] = self.word()
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                out["props"].append((key, self.operand()))
                self.take(",")
        self.need(")")
        if out["name"] is None:
            self.names += 1
            out["name"] = f"_{self.names}"
        return out

    def path(self) -> dict:
        nodes, hops = [self.node()], []
        while self.peek("-") or self.peek("<-"):
            back = self.take("<-")
            if not back:
                self.need("-")
            self.need("[")
            self.need(":")
            relation = self.word()
            self.need("]")
            if back:
                self.need("-")
            else:
                self.need("->")
            other = self.node()
            if relation.startswith("FROM_") and other["label"] == relation[5:]:  # the edge as a node
                self.need("-")
                self.need("[")
                self.need(":")
                if self.word() != f"TO_{relation[5:]}":
                    raise PatternError(f"FROM_{relation[5:]} must lead to TO_{relation[5:]}")
                self.need("]")
                self.need("->")
                hops.append((relation[5:], back, other["name"]))
                nodes.append(self.node())
            else:
                hops.append((relation, back, None))
                nodes.append(other)
        return {"nodes": nodes, "hops": hops}

    def match(self) -> list[dict]:
        self.need("MATCH")
        paths = [self.path()]
        while self.take(","):
            paths.append(self.path())
        return paths

    def operand(self):  # noqa: ANN202
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "string":
            return ("value", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "number":
            return ("value", float(value) if "." in value else int(value))
        if kind == "param":
            return ("param", value[1:])
        if kind == "word" and self.take("("):
            if value.lower() != "count":
                raise PatternError(f"unknown function {value}")
            distinct = self.take("DISTINCT")
            what = "*" if self.take("*") else self.word()
            if self.take("."):
                what = (what, self.word())
            self.need(")")
            return ("count", what, distinct)
        if kind == "word" and self.take("."):
            return ("prop", value, self.word())
        if kind == "word" and value.upper() in ("TRUE", "FALSE", "NULL"):
            return ("value", {"TRUE": True, "FALSE": False, "NULL": None}[value.upper()])
        if kind == "word":
            return ("node", value)
        raise PatternError(f"unexpected {value!r}")

    def test(self):  # noqa: ANN202
        out = self.both()
        while self.take("OR"):
            out = ("or", out, self.both())
        return out

    def both(self):  # noqa: ANN202
        out = self.one()
        while self.take("AND"):
            out = ("and", out, self.one())
        return out

    def one(self):  # noqa: ANN202
        if self.take("NOT", "EXISTS"):
            self.need("{")
            paths = self.match()
            where = self.test() if self.take("WHERE") else None
            self.need("}")
            return ("not exists", paths, where)
        if self.take("NOT"):
            return ("not", self.one())
        if self.take("("):
            out = self.test()
            self.need(")")
            return out
        left = self.operand()
        if left[0] == "node" and self.take(":"):
            return ("label", left[1], self.word())
        for mark in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take(mark):
                return (mark, left, self.operand())
        if self.take("CONTAINS"):
            return ("contains", left, self.operand())
        if self.take("STARTS", "WITH"):
            return ("starts", left, self.operand())
        if self.take("ENDS", "WITH"):
            return ("ends", left, self.operand())
        if self.take("IS", "NOT", "NULL"):
            return ("not", ("null", left))
        if self.take("IS", "NULL"):
            return ("null", left)
        raise PatternError("expected a comparison")

    def single(self) -> dict:
        out = {"paths": self.match(), "where": self.test() if self.take("WHERE") else None}
        self.need("RETURN")
        out["distinct"] = self.take("DISTINCT")
        out["items"] = []
        while True:
            item = self.operand()
            out["items"].append((item, self.word() if self.take("AS") else None))
            if not self.take(","):
                return out

    def statement(self) -> dict:
        parts = [self.single()]
        while self.take("UNION"):
            self.need("ALL")
            parts.append(self.single())
        order, limit = [], None
        if self.take("ORDER"):
            self.need("BY")
            while True:
                key = self.operand()
                order.append((key, bool(self.take("DESC")) or (self.take("ASC") and False)))
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            limit = self.operand()
        if self.at != len(self.items):
            raise PatternError(f"unexpected {self.items[self.at][1]!r}")
        return {"parts": parts, "order": order, "limit": limit}


def columns(items: list) -> list[str]:
    """An alias; else what follows the dot, with its node's name where that alone would stand twice."""
    plain = [alias or (x[2] if x[0] == "prop" else "count" if x[0] == "count" else x[1] if x[0] == "node" else str(x[1])) for x, alias in items]
    return [f"{x[1]}_{x[2]}" if not alias and x[0] == "prop" and plain.count(name) > 1 else name for (x, alias), name in zip(items, plain, strict=True)]


class Compiler:
    def __init__(self, nodes: DataFrame, edges: DataFrame, parameters: dict | None = None):
        self.nodes, self.edges, self.parameters = nodes, edges, parameters or {}

    def _at(self, name: str, prop: str) -> str:
        return f"{name}__{prop}"

    def value(self, x) -> Column:  # noqa: ANN001
        if x[0] == "value":
            return F.lit(x[1])
        if x[0] == "param":
            if x[1] not in self.parameters:
                raise PatternError(f"missing parameter ${x[1]}")
            return F.lit(self.parameters[x[1]])
        if x[0] == "prop":
            return F.col(self._at(x[1], x[2]))
        if x[0] == "node":
            return F.col(self._at(x[1], "id"))
        raise PatternError(f"{x[0]} is not a value here")

    def test(self, x) -> Column:  # noqa: ANN001
        kind = x[0]
        if kind in ("and", "or"):
            a, b = self.test(x[1]), self.test(x[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self.test(x[1])
        if kind == "label":
            return F.col(self._at(x[1], "node_type")) == x[2]
        if kind == "null":
            return self.value(x[1]).isNull()
        if kind == "not exists":
            raise PatternError("NOT EXISTS may only stand at the top of WHERE, joined by AND")
        a, b = self.value(x[1]), self.value(x[2])
        return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "contains": lambda: a.contains(b), "starts": lambda: a.startswith(b), "ends": lambda: a.endswith(b)}[kind]()

    def node(self, spec: dict) -> DataFrame:
        rows = self.nodes if spec["label"] is None else self.nodes.where(F.col("node_type") == spec["label"])
        for key, value in spec["props"]:
            rows = rows.where(F.col(key) == self.value(value))
        return rows.select(*[F.col(c).alias(self._at(spec["name"], c)) for c in self.nodes.columns])

    def match(self, paths: list[dict]) -> DataFrame:
        """Node by node along each path; a name met before joins on its id instead of adding rows."""
        frame, bound = None, set()
        for path in paths:
            for i, spec in enumerate(path["nodes"]):
                name = spec["name"]
                if i == 0:
                    if frame is None:
                        frame = self.node(spec)
                    elif name not in bound:
                        raise PatternError("paths must share a named node")
                else:
                    relation, back, edge = path["hops"][i - 1]
                    before = path["nodes"][i - 1]["name"]
                    edge = edge or f"_e{len(bound)}_{i}"
                    a, b = ("target_id", "source_id") if back else ("source_id", "target_id")
                    e = self.edges.where(F.col("edge_type") == relation).select(*[F.col(c).alias(self._at(edge, c)) for c in self.edges.columns])
                    frame = frame.join(e, F.col(self._at(before, "id")) == F.col(self._at(edge, a)))
                    if name in bound:
                        frame = frame.where(F.col(self._at(edge, b)) == F.col(self._at(name, "id")))
                        continue
                    if spec["label"] is None and not spec["props"] and name.startswith("_"):
                        frame = frame.join(self.nodes.select(F.col("id").alias(self._at(name, "id"))), F.col(self._at(edge, b)) == F.col(self._at(name, "id")))
                    else:
                        frame = frame.join(self.node(spec), F.col(self._at(edge, b)) == F.col(self._at(name, "id")))
                bound.add(name)
        return frame

    def single(self, part: dict) -> DataFrame:
        frame = self.match(part["paths"])
        named = {n["name"] for p in part["paths"] for n in p["nodes"] if not n["name"].startswith("_")}
        for clause in _conjuncts(part["where"]):
            if clause[0] == "not exists":
                inner = self.match(clause[1])
                if clause[2] is not None:
                    inner = inner.where(self.test(clause[2]))
                shared = sorted(named & {n["name"] for p in clause[1] for n in p["nodes"]})
                if not shared:
                    raise PatternError("NOT EXISTS must name a node of the outer pattern")
                keys = [self._at(n, "id") for n in shared]
                frame = frame.join(inner.select(*keys).distinct(), keys, "left_anti")
            else:
                frame = frame.where(self.test(clause))
        names = columns(part["items"])
        if any(x[0] == "count" for x, _ in part["items"]):
            keys = [self.value(x).alias(n) for (x, _), n in zip(part["items"], names, strict=True) if x[0] != "count"]
            counted = [_count(self, x).alias(n) for (x, _), n in zip(part["items"], names, strict=True) if x[0] == "count"]
            return (frame.groupBy(*keys) if keys else frame).agg(*counted).select(*names)
        out = frame.select(*[self.value(x).alias(n) for (x, _), n in zip(part["items"], names, strict=True)])
        return out.distinct() if part["distinct"] else out

    def statement(self, tree: dict) -> DataFrame:
        out = reduce(lambda a, b: a.union(b), [self.single(p) for p in tree["parts"]])
        if tree["order"]:
            first = tree["parts"][0]
            names = dict(zip([x for x, _ in first["items"]], columns(first["items"]), strict=True))
            keys = []
            for key, down in tree["order"]:
                name = names.get(key) or (key[1] if key[0] == "node" and key[1] in out.columns else None)
                if name is None:
                    raise PatternError("ORDER BY must name a returned column")
                keys.append(F.desc(name) if down else F.asc(name))
            out = out.orderBy(*keys)
        if tree["limit"] is not None:
            out = out.limit(int(tree["limit"][1] if tree["limit"][0] == "value" else self.parameters[tree["limit"][1]]))
        return out


def _conjuncts(test) -> list:  # noqa: ANN001
    if test is None:
        return []
    return [*_conjuncts(test[1]), *_conjuncts(test[2])] if test[0] == "and" else [test]


def _count(compiler: Compiler, x) -> Column:  # noqa: ANN001
    if x[1] == "*":
        return F.count("*")
    column = F.col(compiler._at(*x[1])) if isinstance(x[1], tuple) else F.col(compiler._at(x[1], "id"))
    return F.count_distinct(column) if x[2] else F.count(column)


def compile_pattern(statement: str, nodes: DataFrame, edges: DataFrame, parameters: dict | None = None) -> DataFrame:
    return Compiler(nodes, edges, parameters).statement(_Parser(check_read_only(statement)).statement())


def run_pattern(statement: str, nodes: DataFrame, edges: DataFrame, parameters: dict | None = None, limit: int = 100) -> dict:
    """Rows up to ``limit`` (1 to 1000), their columns, and whether there were more."""
    limit = max(1, min(limit, 1000))
    frame = compile_pattern(statement, nodes, edges, parameters)
    rows = [list(r) for r in frame.limit(limit + 1).collect()]
    return {"columns": frame.columns, "rows": rows[:limit], "row_count": min(len(rows), limit), "truncated": len(rows) > limit}
