"""Schemas that drift from file to file: the cheapest edit script between neighbours, and one table from all.

A schema is a tree of fields. The tree edit distance between two of them, with cost 1 for adding, deleting, renaming or
retyping a field, yields the script; fields with different identities are never matched (that would cost more than
deleting one and adding the other), and a deletion with an insertion of the same identity elsewhere is a move. The
children of a node are compared in the order of their identities, since their written order carries no meaning.

Edge cases, as tested: empty schemas, equal schemas, structs that become leaves, a type that is unknown (never
retyped), repeated field names (the first stands for the field), empty tables, clashing extra columns, null headers
(a batch without fields) and null lines (no cells).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.cluster import cut
from tallygrid.operators.ordered import before


@dataclass(frozen=True)
class Node:
    """A field: its name as written, its identity over time, its type (None: unknown) and its children."""

    name: str
    identity: str
    kind: str | None = None
    children: tuple["Node", ...] = ()


@dataclass(frozen=True)
class Change:
    """One step of a script. ``at`` is the field's path of identities in the old tree, ``to`` and ``place`` where it comes to in the new one."""

    kind: str
    identity: str
    old: str | None = None
    new: str | None = None
    at: tuple[str, ...] = field(default=(), compare=False)
    to: tuple[str, ...] = field(default=(), compare=False)
    place: int = field(default=-1, compare=False)
    made: str | None = field(default=None, compare=False)


def node_of(name: str, kind: T.DataType, identity: Callable[[str], str] = str) -> Node:
    """The tree of a Spark type; arrays and maps hang their element below them."""
    inner: list[Node] = []
    if isinstance(kind, T.StructType):
        inner = [node_of(f.name, f.dataType, identity) for f in kind.fields]
        label = "struct"
    elif isinstance(kind, T.ArrayType):
        inner, label = [node_of("element", kind.elementType, identity)], "array"
    elif isinstance(kind, T.MapType):
        inner, label = [node_of("key", kind.keyType, identity), node_of("value", kind.valueType, identity)], "map"
    else:
        label = kind.simpleString()
    return Node(name, identity(name), label, tuple(inner))


class _Numbered:
    """A tree in postorder, children sorted by identity, the first of equal identities kept."""

    def __init__(self, root: Node) -> None:
        self.nodes: list[Node] = []
        self.left: list[int] = []
        self.parent: list[int] = []
        self.place: list[int] = []
        self._walk(root, 0)
        self.keyroots = [i for i in range(len(self.nodes)) if all(self.left[j] != self.left[i] for j in range(i + 1, len(self.nodes)))]

    def _walk(self, node: Node, place: int) -> tuple[int, int]:
        first: dict[str, tuple[int, Node]] = {}
        for child in node.children:
            first.setdefault(child.identity, (len(first), child))
        mine, leftmost = [], None
        for k, child in sorted(first.values(), key=lambda kc: kc[1].identity):
            at, low = self._walk(child, k)
            mine.append(at)
            leftmost = low if leftmost is None else leftmost
        here = len(self.nodes)
        self.nodes.append(node)
        self.left.append(here if leftmost is None else leftmost)
        self.parent.append(-1)
        self.place.append(place)
        for m in mine:
            self.parent[m] = here
        return here, self.left[here]

    def path(self, i: int) -> tuple[str, ...]:
        """Identities from below the root down to a node."""
        return (*self.path(self.parent[i]), self.nodes[i].identity) if self.parent[i] >= 0 else ()


def _relabel(a: Node, b: Node) -> float:
    if a.identity != b.identity:
        return 3.0
    return float(a.name != b.name) + float(a.kind is not None and b.kind is not None and a.kind != b.kind)


def _matched(one: _Numbered, two: _Numbered) -> tuple[float, list[tuple[int, int]]]:
    """Distance and matched nodes, by the keyroot recurrence for ordered trees (Zhang and Shasha, 1989)."""
    n, m = len(one.nodes), len(two.nodes)
    tree = [[0.0] * m for _ in range(n)]

    def forest(i: int, j: int) -> list[list[float]]:
        li, lj = one.left[i], two.left[j]
        d = [[0.0] * (j - lj + 2) for _ in range(i - li + 2)]
        for x in range(1, i - li + 2):
            d[x][0] = d[x - 1][0] + 1
        for y in range(1, j - lj + 2):
            d[0][y] = d[0][y - 1] + 1
        for x in range(1, i - li + 2):
            for y in range(1, j - lj + 2):
                p, q = li + x - 1, lj + y - 1
                if one.left[p] == li and two.left[q] == lj:
                    d[x][y] = min(d[x - 1][y] + 1, d[x][y - 1] + 1, d[x - 1][y - 1] + _relabel(one.nodes[p], two.nodes[q]))
                    tree[p][q] = d[x][y]
                else:
                    d[x][y] = min(d[x - 1][y] + 1, d[x][y - 1] + 1, d[one.left[p] - li][two.left[q] - lj] + tree[p][q])
        return d

    for i in one.keyroots:
        for j in two.keyroots:
            forest(i, j)
    pairs, todo = [], [(n - 1, m - 1)]
    while todo:
        i, j = todo.pop()
        d, li, lj = forest(i, j), one.left[i], two.left[j]
        x, y = i - li + 1, j - lj + 1
        while x and y:
            p, q = li + x - 1, lj + y - 1
            if d[x][y] == d[x - 1][y] + 1:
                x -= 1
            elif d[x][y] == d[x][y - 1] + 1:
                y -= 1
            elif one.left[p] == li and two.left[q] == lj:
                pairs.append((p, q))
                x, y = x - 1, y - 1
            else:
                todo.append((p, q))
                x, y = one.left[p] - li, two.left[q] - lj
    return tree[n - 1][m - 1], pairs


def _rising(numbers: list[int]) -> set[int]:
    """Places of a longest increasing subsequence."""
    best: list[tuple[int, int]] = []
    for i, v in enumerate(numbers):
        length, back = max(((best[j][0], j) for j in range(i) if numbers[j] < v), default=(0, -1))
        best.append((length + 1, back))
    kept, at = set(), max(range(len(best)), key=lambda i: best[i][0], default=-1)
    while at >= 0:
        kept.add(at)
        at = best[at][1]
    return kept


def edit_script(old: Node, new: Node) -> list[Change]:
    """The cheapest changes that turn one schema into the other; kinds added, removed, renamed, retyped and moved."""
    one, two = _Numbered(old), _Numbered(new)
    _, pairs = _matched(one, two)
    there, back = dict(pairs), {q: p for p, q in pairs}
    come: dict[str, list[int]] = {}
    for q in range(len(two.nodes)):
        if q not in back:
            come.setdefault(two.nodes[q].identity, []).append(q)
    out, moved = [], []
    for p in range(len(one.nodes)):
        if p not in there:
            if come.get(one.nodes[p].identity):
                moved.append((p, come[one.nodes[p].identity].pop(0)))
            else:
                out.append(Change("removed", one.nodes[p].identity, one.nodes[p].name, None, one.path(p)))
    out += [Change("added", i, None, two.nodes[q].name, (), two.path(q), two.place[q], two.nodes[q].kind) for i, qs in come.items() for q in qs]
    siblings: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for p, q in [*pairs, *moved]:
        a, b = one.nodes[p], two.nodes[q]
        if one.parent[p] >= 0 and there.get(one.parent[p]) == two.parent[q]:
            siblings.setdefault((one.parent[p], two.parent[q]), []).append((one.place[p], two.place[q], p, q))
        elif one.parent[p] >= 0:
            out.append(Change("moved", b.identity, one.nodes[one.parent[p]].identity, two.nodes[two.parent[q]].identity if two.parent[q] >= 0 else None, one.path(p), two.path(q), two.place[q]))
        if a.name != b.name:
            out.append(Change("renamed", b.identity, a.name, b.name, one.path(p)))
        if a.kind is not None and b.kind is not None and a.kind != b.kind:
            out.append(Change("retyped", b.identity, a.kind, b.kind, one.path(p)))
    for group in siblings.values():
        group.sort()
        kept = _rising([to for _, to, *_ in group])
        out += [Change("moved", two.nodes[q].identity, str(was), str(to), one.path(p), two.path(q), to) for k, (was, to, p, q) in enumerate(group) if k not in kept]
    return sorted(out, key=lambda c: (c.kind, c.identity, c.at, c.to))


@dataclass
class Planned:
    """A field of the schema that a script leads to; ``source`` is the path of names of the old field it is taken from."""

    name: str
    identity: str
    kind: str | None
    source: tuple[str, ...] | None
    children: list["Planned"] = field(default_factory=list)


def apply_script(old: Node, script: list[Change]) -> Planned:
    """The tree that the steps lead to: fields are taken out, changed, and put in at their places, parents first."""
    found: dict[tuple[str, ...], Planned] = {}
    above: dict[tuple[str, ...], Planned] = {}

    def plant(node: Node, path: tuple[str, ...], source: tuple[str, ...]) -> Planned:
        out = found[path] = Planned(node.name, node.identity, node.kind, source)
        for child in node.children:
            at = (*path, child.identity)
            if at not in found:
                above[at] = out
                out.children.append(plant(child, at, (*source, child.name)))
        return out

    root = plant(old, (), ())
    for c in script:
        if c.kind == "renamed":
            found[c.at].name = c.new
        elif c.kind == "retyped":
            found[c.at].kind = c.new
        elif c.kind in ("removed", "moved"):
            above[c.at].children = [x for x in above[c.at].children if x is not found[c.at]]
    for c in sorted((c for c in script if c.kind in ("added", "moved")), key=lambda c: (len(c.to), c.place)):
        parent = root
        for identity in c.to[:-1]:
            parent = next(x for x in parent.children if x.identity == identity)
        parent.children.insert(c.place, found[c.at] if c.kind == "moved" else Planned(c.new, c.identity, c.made, None))
    return root


def distance(old: Node, new: Node) -> float:
    """The cost of the cheapest script, moves counted as a deletion and an insertion."""
    return _matched(_Numbered(old), _Numbered(new))[0]


#: Types from narrow to wide; what isn't here widens to string.
WIDTHS = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]


def widest(kinds: list[T.DataType]) -> T.DataType:
    """One type that holds all of them: the wider number, structs field by field, else string."""
    first = kinds[0]
    if all(k == first for k in kinds):
        return first
    if all(isinstance(k, T.StructType) for k in kinds):
        return consistent(kinds)
    if all(isinstance(k, T.ArrayType) for k in kinds):
        return T.ArrayType(widest([k.elementType for k in kinds]))
    names = [k.simpleString() for k in kinds]
    if all(x in WIDTHS[1:] for x in names):
        return kinds[names.index(max(names, key=WIDTHS.index))]
    if set(names) <= {"date", "timestamp", "timestamp_ntz"}:
        return T.TimestampType()
    return T.StringType()


def consistent(schemas: list[T.StructType], identity: Callable[[str], str] = str) -> T.StructType:
    """One schema for all of them: fields by identity, in order of first appearance, each as wide as needed."""
    seen: dict[str, list[T.DataType]] = {}
    for s in schemas:
        for f in s.fields:
            seen.setdefault(identity(f.name), []).append(f.dataType)
    return T.StructType([T.StructField(k, widest(v)) for k, v in seen.items()])


def _ddl(f: Planned) -> str:
    if f.kind == "struct":
        return "struct<" + ",".join(f"`{c.name}`:{_ddl(c)}" for c in f.children) + ">"
    if f.kind in ("array", "map"):
        return f"{f.kind}<{','.join(map(_ddl, f.children))}>"
    return f.kind or "void"


def _reach(source: tuple[str, ...] | None, base: tuple[str, ...], value: Column | None, have: T.DataType) -> tuple[Column, T.DataType] | None:
    """The old field at a path, if only structs lie between it and where ``value`` is."""
    if source is None or source[: len(base)] != base:
        return None
    for name in source[len(base) :]:
        if not isinstance(have, T.StructType):
            return None
        value = F.col(f"`{name}`") if value is None else value.getField(name)
        have = have[name].dataType
    return value, have


def _from_elsewhere(f: Planned, home: tuple[str, ...] | None) -> bool:
    """Whether the field or one below it is taken from outside ``home``; without a home, from anywhere."""
    own = f.source is not None and (home is None or f.source[: len(home)] != home)
    return own or any(_from_elsewhere(c, home) for c in f.children)


def _column(f: Planned, base: tuple[str, ...], value: Column | None, have: T.DataType) -> Column:
    got, none = _reach(f.source, base, value, have), F.lit(None).cast(_ddl(f))
    if f.kind == "struct":
        if got is not None and not isinstance(got[1], T.StructType) or not f.children:
            return none
        inner = [_column(c, base, value, have).alias(c.name) for c in f.children]
        # there if the struct was, or if a field that has come in from elsewhere is
        there = [got[0].isNotNull()] if got is not None else []
        there += [x.isNotNull() for x, c in zip(inner, f.children, strict=True) if _from_elsewhere(c, f.source if got is not None else None)]
        return F.when(reduce(Column.__or__, there), F.struct(*inner)) if there else none
    if got is None:
        return none
    column, kind = got
    if f.kind is None or _ddl(f).replace("`", "") == kind.simpleString():
        return column
    if f.kind == "array":
        return F.transform(column, lambda x: _column(f.children[0], (*f.source, "element"), x, kind.elementType)) if isinstance(kind, T.ArrayType) else none
    if f.kind == "map":
        if not isinstance(kind, T.MapType):
            return none
        key, of = f.children
        turned = F.transform_values(column, lambda _, x: _column(of, (*f.source, "value"), x, kind.valueType))
        return turned if _ddl(key) == kind.keyType.simpleString() else F.transform_keys(turned, lambda k, _: _column(key, (*f.source, "key"), k, kind.keyType))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column) if f.kind == "string" else none
    return column.try_cast(f.kind)


def compile_script(have: T.StructType, script: list[Change], identity: Callable[[str], str] = str) -> list[Column]:
    """A script from the schema ``have`` as a projection: picks, renames, casts, moves, and nulls for added fields.

    A value that doesn't cast is null, a struct or array that becomes text is JSON, and a field can't be moved out of or
    into the elements of an array or map: it is null there.
    """
    return [_column(f, (), None, have).alias(f.name) for f in apply_script(node_of("", have, identity), script).children]


def projection(have: T.StructType, want: T.StructType, identity: Callable[[str], str] = str) -> list[Column]:
    """What the cheapest script from one schema to the other compiles to; the fields of ``want`` are named by their identities."""
    return compile_script(have, edit_script(node_of("", have, identity), node_of("", want)), identity)


def read_consistent(spark: SparkSession, groups: list[list[str]], identity: Callable[[str], str] = str, form: str = "parquet", want: T.StructType | None = None) -> tuple[DataFrame, list[list[Change]]]:
    """Groups of files, each group with one schema, in order of time, as one table, and the changes from group to group.

    The table has the schema ``want``, whose fields are named by identity, or else one that holds all of the groups'. The
    script from each group's schema to it is applied to the group's files.
    """
    frames = [spark.read.format(form).load(g) for g in groups]
    schemas = [f.schema for f in frames]
    want = consistent(schemas, identity) if want is None else want
    trees = [node_of("", s, identity) for s in schemas]
    table = reduce(DataFrame.unionAll, [f.select(*projection(f.schema, want, identity)) for f in frames])
    return table, [edit_script(a, b) for a, b in zip(trees, trees[1:], strict=False)]


#: What surrounds names and cells, cells that are missing, and the types from narrow to wide.
AROUND = ' \t"'
MISSING = ["", "na", "nan", "null", "none", "?"]
CELL_TYPES = ["", "whole", "decimal", "text"]
WHOLE, DECIMAL = r"\A[+-]?[0-9]+\z", r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def _cells(text: str) -> Column:
    parts = F.expr(f"split({text}, concat('\\\\Q', delimiter, '\\\\E'))")
    return F.when(F.length("delimiter") > 0, F.transform(parts, lambda c: F.btrim(c, F.lit(AROUND)))).otherwise(F.array(F.btrim(F.col(text), F.lit(AROUND))))


def _width(cell: Column) -> Column:
    return F.when(cell.isNull() | F.lower(cell).isin(MISSING), 0).when(cell.rlike(WHOLE), 1).when(cell.rlike(DECIMAL), 2).otherwise(3).cast("tinyint")


def batch_schemas(batches: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """``batch_id, stream, exported_at, fields``: the fields of each batch in written order, with name, identity and type.

    Cell types are reduced to one number per line and column and combined before the shuffle, so a batch with a third
    of all lines costs no task more than others; its join is left to adaptive skew handling.
    """
    head = batches.select("batch_id", "stream", "exported_at", "delimiter", "header").dropDuplicates(["batch_id"])
    typed = lines.select("batch_id", "line").join(head.select("batch_id", "delimiter"), "batch_id").select("batch_id", F.posexplode(F.transform(_cells("line"), _width)).alias("pos", "width"))
    widths = typed.groupBy("batch_id", "pos").agg(F.max("width").alias("width"))
    written = head.select("batch_id", F.posexplode(_cells("header")).alias("pos", "name"))
    known = names.select(F.col("known_name").alias("name"), "field").dropDuplicates(["name"])
    fields = written.join(known, "name", "left").join(widths, ["batch_id", "pos"], "left")
    listed = fields.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", F.coalesce("field", "name").alias("identity"), F.coalesce("width", F.lit(0)).alias("width")))).alias("fields"))
    return head.select("batch_id", "stream", "exported_at").join(listed, "batch_id", "left")


FIELDS = "array<struct<pos:int,name:string,identity:string,width:tinyint>>"


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """Over as many tasks as there are cores or shuffle partitions: few bytes, but work for each row, that Spark would put into one task."""
    spark = df.sparkSession
    # by a hash of its own: by the columns themselves the optimizer would drop it after an aggregation by them
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64(*columns))


def batch_changes(schemas: DataFrame) -> DataFrame:
    """``batch_id, stream, field, change_kind, old, new``: the edit script from the batch before in the stream to each batch.

    Each distinct pair of schemas is compared once, the pairs spread over all tasks.
    """
    follow = before(cut(schemas), "stream", ["exported_at", "batch_id"], "fields", "earlier").filter(F.col("earlier").isNotNull() & F.col("fields").isNotNull())
    # pairs go by a digest of 128 bits, in which no two different ones are to be expected to agree
    digests = [F.xxhash64(F.lit(seed), "earlier", "fields").alias(f"h{seed}") for seed in (1, 2)]
    follow = cut(follow.select("batch_id", "stream", F.col("earlier").cast(FIELDS).alias("earlier"), F.col("fields").cast(FIELDS).alias("fields")).select("*", *digests))

    def tree(fields: list[dict]) -> Node:
        return Node("", "", "struct", tuple(Node(f["name"], f["identity"], CELL_TYPES[f["width"]] or None) for f in fields))

    def scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.struct([(n, pa.string()) for n in ("identity", "kind", "old", "new")])
        for batch in batches:
            found = [[{"identity": c.identity, "kind": c.kind, "old": c.old, "new": c.new} for c in edit_script(tree(old), tree(new))] for old, new in zip(batch.column("earlier").to_pylist(), batch.column("fields").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(found, pa.list_(step))], names=["h1", "h2", "steps"])

    pairs = _spread(follow.select("h1", "h2", "earlier", "fields").dropDuplicates(["h1", "h2"]), "h1", "h2")
    known = pairs.mapInArrow(scripts, "h1 bigint, h2 bigint, steps array<struct<identity:string,kind:string,old:string,new:string>>").filter("size(steps) > 0")
    listed = follow.select("batch_id", "stream", "h1", "h2").join(known, ["h1", "h2"]).select("batch_id", "stream", F.explode("steps").alias("s"))
    return listed.select("batch_id", "stream", F.col("s.identity").alias("field"), F.col("s.kind").alias("change_kind"), "s.old", "s.new")


def unified_lines(batches: DataFrame, lines: DataFrame, names: DataFrame, target: dict[str, str], raw: str | None = None, script: Callable[[Node, Node], list[Change]] = edit_script) -> DataFrame:
    """All lines, each once, in one schema: ``batch_id, line_no``, the target fields with their types, and ``others``.

    For each distinct header the script to the target is compiled into two maps, from target field to position and
    whether its text is cast, and from field that is taken out to position, by which the cells of all its lines are
    picked. Cells that are missing or not of the type are null; fields outside the target are kept in the map ``others``.
    ``raw`` names a map from target field to the text of a cell that is there but not of the type, so that no cell is lost.
    """
    head = batches.select("batch_id", "delimiter", "header").dropDuplicates(["batch_id"])
    known = names.select(F.col("known_name").alias("name"), "field").dropDuplicates(["name"])
    written = head.select("batch_id", F.posexplode(_cells("header")).alias("pos", "name")).join(known, "name", "left")
    kind = "array<struct<pos:int,name:string,identity:string>>"
    layouts = cut(written.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", F.coalesce("field", "name").alias("identity")))).cast(kind).alias("fields")))
    want = Node("", "", "struct", tuple(Node(k, k, t) for k, t in target.items()))

    def compiled(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = pa.map_(pa.string(), pa.struct([("pos", pa.int32()), ("typed", pa.bool_())]))
        for batch in stream:
            plans, rests = [], []
            for fields in batch.column("fields").to_pylist():
                old = Node("", "", "struct", tuple(Node(f["name"], f["identity"], "string") for f in fields))
                at: dict[str, int] = {}
                for f in fields:
                    at.setdefault(f["name"], f["pos"])
                steps = script(old, want)
                plans.append([(f.name, {"pos": at[f.source[0]], "typed": f.kind == target[f.name]}) for f in apply_script(old, steps).children if f.source and f.name in target])
                rests.append([(c.identity, at[c.old]) for c in steps if c.kind == "removed"])
            yield pa.RecordBatch.from_arrays([batch.column("fields"), pa.array(plans, picks), pa.array(rests, pa.map_(pa.string(), pa.int32()))], names=["fields", "plan", "rest"])

    plans = _spread(layouts.select("fields").distinct(), "fields").mapInArrow(compiled, f"fields {kind}, plan map<string,struct<pos:int,typed:boolean>>, rest map<string,int>")
    plan = layouts.join(plans, "fields").select("batch_id", "plan", "rest")
    once = lines.select("batch_id", "line_no", "line").dropDuplicates(["batch_id", "line_no"])
    cells = once.join(head.select("batch_id", "delimiter"), "batch_id").join(plan, "batch_id").withColumn("cells", _cells("line"))

    def pick(at: Column) -> Column:
        cell = F.get(F.col("cells"), at)
        return F.when(_width(cell) > 0, cell)

    rest = F.transform_values("rest", lambda _, at: pick(at))
    place = {k: F.element_at(F.col("plan"), F.lit(k)) for k in target}
    texts = {k: pick(p["pos"]) for k, p in place.items()}
    typed = {k: F.when(place[k]["typed"], texts[k].try_cast(t)) for k, t in target.items()}
    out = [c.alias(k) for k, c in typed.items()]
    if raw is not None:
        uncast = F.create_map(*[x for k in target for x in (F.lit(k), F.when(typed[k].isNull(), texts[k]))])
        out.append(F.map_filter(uncast, lambda _, v: v.isNotNull()).alias(raw))
    return cells.select("batch_id", "line_no", *out, rest.alias("others"))
