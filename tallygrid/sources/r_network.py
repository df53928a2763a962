"""Networks written as R source: a model string and arrays of probabilities, read by a small evaluator.

Only what such files use is understood: numbers, strings, names, arithmetic with recycling, ranges, and the functions
``c rep round sum seq list array matrix``. Other statements are passed over. Nothing is executed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators import graphs as G
from tallygrid.operators.factors import Tables

TOKEN = re.compile(r"""\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?L?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z.][\w.]*|`[^`]+`)|(?P<op><-|[-+*/^(),=:\[\]$|~{}]))""")


class NotUnderstood(ValueError):
    """An expression outside the subset."""


@dataclass
class Named:
    """A list with names."""

    items: list[tuple[str | None, object]] = field(default_factory=list)


class _Reader:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str, env: dict[str, object]) -> None:
        self.tokens, self.at, self.env = [], 0, env
        pos, text = 0, text.strip()
        while pos < len(text):
            m = TOKEN.match(text, pos)
            if not m or m.end() == pos:
                raise NotUnderstood(text[pos : pos + 20])
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if kind == "end" or value is not None and got != value:
            raise NotUnderstood(f"{got!r} in place of {value!r}")
        self.at += 1
        return got

    def whole(self) -> object:
        out = self.sum()
        if self.peek()[0] != "end":
            raise NotUnderstood(self.peek()[1])
        return out

    def sum(self) -> object:
        out = self.term()
        while self.peek()[1] in ("+", "-"):
            op, right = self.take(), self.term()
            out = _recycled(out, right, np.add if op == "+" else np.subtract)
        return out

    def term(self) -> object:
        out = self.range()
        while self.peek()[1] in ("*", "/"):
            op, right = self.take(), self.range()
            out = _recycled(out, right, np.multiply if op == "*" else np.divide)
        return out

    def range(self) -> object:
        out = self.unary()
        if self.peek()[1] == ":":
            self.take()
            a, b = float(_numbers(out)[0]), float(_numbers(self.unary())[0])
            return np.arange(a, b + 1) if a <= b else np.arange(a, b - 1, -1)
        return out

    def unary(self) -> object:
        if self.peek()[1] in ("-", "+"):
            sign = -1.0 if self.take() == "-" else 1.0
            return sign * _numbers(self.unary())
        out = self.atom()
        if self.peek()[1] == "^":
            self.take()
            return _recycled(out, self.unary(), np.power)
        return out

    def atom(self) -> object:
        kind, got = self.peek()
        if kind == "num":
            return np.array([float(self.take().rstrip("L"))])
        if kind == "str":
            return [self.take()[1:-1].replace("\\\"", "\"")]
        if got == "(":
            self.take()
            out = self.sum()
            self.take(")")
            return out
        if kind != "name":
            raise NotUnderstood(got)
        name = self.take().strip("`")
        if self.peek()[1] == "(":
            return _call(name, self.arguments())
        if name in ("TRUE", "FALSE"):
            return np.array([float(name == "TRUE")])
        if name in ("NA", "NaN"):
            return np.array([np.nan])
        if name == "NULL":
            return []
        if name not in self.env:
            raise NotUnderstood(f"no value of {name}")
        return self.env[name]

    def arguments(self) -> list[tuple[str | None, object]]:
        self.take("(")
        out: list[tuple[str | None, object]] = []
        while self.peek()[1] != ")":
            key = None
            if self.peek()[0] in ("name", "str") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "=":
                key = self.take().strip("`\"'")
                self.take("=")
            out.append((key, self.sum()))
            if self.peek()[1] == ",":
                self.take()
        self.take(")")
        return out


def _numbers(x: object) -> np.ndarray:
    if isinstance(x, np.ndarray):
        return x
    raise NotUnderstood("a number is needed")


def _recycled(a: object, b: object, f) -> np.ndarray:
    x, y = _numbers(a), _numbers(b)
    n = max(len(x), len(y)) if len(x) and len(y) else 0
    with np.errstate(all="ignore"):
        return f(np.resize(x, n), np.resize(y, n))


def _call(name: str, args: list[tuple[str | None, object]]) -> object:
    plain = [v for k, v in args if k is None]
    keyed = {k: v for k, v in args if k is not None}
    if name == "c":
        values = [v for _, v in args]
        if any(isinstance(v, list) for v in values):
            return [s for v in values for s in (v if isinstance(v, list) else [f"{x:g}" for x in _numbers(v)])]
        return np.concatenate([_numbers(v) for v in values]) if values else np.zeros(0)
    if name == "list":
        return Named(args)
    if name == "rep":
        x = plain[0]
        each = int(_numbers(keyed.get("each", np.array([1.0])))[0])
        times = _numbers(keyed.get("times", plain[1] if len(plain) > 1 else np.array([1.0]))).astype(int)
        base = [v for v in x for _ in range(each)]
        out = [v for v, t in zip(base, times, strict=False) for _ in range(t)] if len(times) > 1 else base * int(times[0])
        out = out[: int(_numbers(keyed["length.out"])[0])] if "length.out" in keyed else out
        return out if isinstance(x, list) else np.array(out)
    if name == "round":
        digits = keyed.get("digits", plain[1] if len(plain) > 1 else np.array([0.0]))
        return np.round(_numbers(plain[0]), int(_numbers(digits)[0]))
    if name == "sum":
        return np.array([np.sum([_numbers(v).sum() for v in plain])])
    if name == "seq":
        a, b = (float(_numbers(v)[0]) for v in plain[:2])
        step = float(_numbers(keyed.get("by", plain[2] if len(plain) > 2 else np.array([1.0])))[0])
        return np.arange(a, b + step / 2, step)
    if name in ("array", "matrix"):
        return Named([("data", keyed.get("data", plain[0] if plain else np.zeros(0))), ("dim", keyed.get("dim", plain[1] if len(plain) > 1 else np.zeros(0))), ("dimnames", keyed.get("dimnames", plain[2] if len(plain) > 2 else Named()))])
    raise NotUnderstood(name)


def statements(text: str) -> Iterator[str]:
    """Top-level statements: comments off, lines joined while brackets are open or an operator is pending."""
    held, depth = "", 0
    for line in text.splitlines():
        quote, bare = "", ""
        for ch in line:
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "\"'":
                quote = ch
            elif ch == "#":
                break
            elif ch in "([{":
                depth += 1
            elif ch in ")]}":
                depth -= 1
            bare += ch
        held = f"{held} {bare.strip()}".strip()
        if depth <= 0 and held and not held.endswith(("<-", "+", "-", "*", "/", ",", "=")):
            yield from (s.strip() for s in ([held] if depth or ";" not in held else held.split(";")) if s.strip())
            held, depth = "", 0
    if held:
        yield held


def parse_model(text: str) -> list[tuple[str, list[str]]]:
    """Variables and their parents from ``[A][B|A:C]``, in order."""
    out = {}
    for token in re.findall(r"\[([^\]]+)\]", text):
        child, _, given = token.partition("|")
        out[child.strip()] = [p.strip() for p in given.split(":") if p.strip()]
    for p in [p for ps in out.values() for p in ps]:
        out.setdefault(p, [])
    return list(out.items())


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


@dataclass
class Definition:
    """A network read from source."""

    name: str
    variables: list[str]
    states: list[list[str]]
    tables: Tables

    @property
    def adjacency(self) -> np.ndarray:
        return self.tables.adjacency()


def parse_network(text: str, name: str = "") -> Definition:
    """The definition in the source.

    Names that differ in case and punctuation are taken as the same. Rows are scaled to sum to 1, missing numbers count 0,
    a variable without a usable array is uniform, with two states if nothing else is known.
    """
    env: dict[str, object] = {}
    arrays: list[tuple[str, Named]] = []
    model = None
    for s in statements(text):
        if m := re.search(r"model2network\s*\(\s*[\"']([^\"']+)[\"']", s):
            model = model or m[1]
            continue
        m = re.match(r"([A-Za-z.][\w.]*|`[^`]+`)\s*(?:<-|=)\s*(.+)$", s, re.DOTALL)
        if not m:
            continue
        try:
            value = _Reader(m[2], env).whole()
        except (NotUnderstood, IndexError, KeyError, ValueError):
            continue
        if isinstance(value, Named) and value.items and value.items[0][0] == "data":
            arrays.append((m[1].strip("`"), value))
        else:
            env[m[1].strip("`")] = value
    if model is None:
        raise ValueError(f"{name}: no model string")
    listed = parse_model(model)
    names = [v for v, _ in listed]
    by_plain = {_plain(v): i for i, v in enumerate(names)}
    states: list[list[str]] = [[] for _ in names]
    found: dict[int, tuple[list[int], list[int], np.ndarray]] = {}
    for variable, a in arrays:
        parts = dict(a.items)
        data, dims = parts["data"], parts["dim"]
        labels = parts["dimnames"].items if isinstance(parts["dimnames"], Named) else []
        axes = [by_plain.get(_plain(k or ""), -1) for k, _ in labels]
        if not axes and _plain(variable) in by_plain:
            axes = [by_plain[_plain(variable)]]
        if not isinstance(data, np.ndarray) or not axes or -1 in axes or len(set(axes)) != len(axes):
            continue
        sizes = [len(v) for _, v in labels] if labels else []
        sizes = [int(x) for x in dims] if isinstance(dims, np.ndarray) and len(dims) == len(axes) else sizes or [len(data)]
        if len(data) == 0 or int(np.prod(sizes)) <= 0:
            continue
        for i, (_, v) in zip(axes, labels, strict=False):
            if isinstance(v, list) and not states[i]:
                states[i] = list(v)
        values = np.nan_to_num(np.resize(data, int(np.prod(sizes))))
        found[axes[0]] = (axes[1:], sizes, values.reshape(-1, sizes[0]))  # first axis fastest: a row for each configuration
    cards = [2] * len(names)
    for v, (parents, sizes, _) in found.items():
        for i, k in zip([v, *parents], sizes, strict=True):
            cards[i] = max(2, k)
    for i, s in enumerate(states):
        cards[i] = max(cards[i], len(s)) if s and i not in found else cards[i]
    at = {v: i for i, v in enumerate(names)}
    all_parents, probs = [], []
    for v, (_, written) in enumerate(listed):
        parents = [at[p] for p in written]
        q, k = int(np.prod([cards[u] for u in parents], dtype=int)), cards[v]
        table = np.full((q, k), 1 / k)
        if v in found and set(found[v][0]) == set(parents) and found[v][2].shape == (q, k):
            parents, rows = found[v][0], np.clip(found[v][2], 0, None)
            total = rows.sum(axis=1, keepdims=True)
            table = np.where(total > 0, rows / np.where(total > 0, total, 1), 1 / k)
        all_parents.append(tuple(parents))
        probs.append(table)
    states = [s if len(s) == k else [str(i) for i in range(k)] for s, k in zip(states, cards, strict=True)]
    t = Tables(tuple(cards), all_parents, probs)
    if not G.is_dag(t.adjacency()):
        raise ValueError(f"{name}: the model has a cycle")
    return Definition(name, names, states, t)


CPD_ROWS = "name string, variable string, var int, parents array<int>, pcfg bigint, state int, p double"


def network_rows(files: DataFrame) -> DataFrame:
    """Tables of every source file (``name, text``) as rows; files that define no network give none."""

    def parse(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for name, text in zip(frame["name"], frame["text"], strict=True):
                try:
                    d = parse_network(text or "", name or "")
                except ValueError:
                    continue
                for v, variable in enumerate(d.variables):
                    rows += [(name, variable, v, list(d.tables.parents[v]), c, s, float(p)) for c, row in enumerate(d.tables.probs[v]) for s, p in enumerate(row)]
            yield pd.DataFrame(rows, columns=["name", "variable", "var", "parents", "pcfg", "state", "p"])

    return files.select(F.col("name").cast("string"), F.col("text").cast("string")).mapInPandas(parse, CPD_ROWS)
