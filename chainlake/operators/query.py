"""Parameterised row queries: numeric expressions, comparisons, AND/OR trees, sums and report tables.

A query is built once, from Python or from JSON, and bound to parameters by value when it becomes a Spark expression, so the same
query can serve many threads. A comparison whose row function doesn't apply to a row (a cell is missing or no number) is
false, not null.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlake.operators.rows import number_rows

OPERATORS = ("+", "-", "*", "/")
COMPARISONS = ("=", ">", ">=", "<", "<=")
ROW_NO = 0


@dataclass(frozen=True)
class Param:
    """A named number that a query takes when it runs; required unless it has a default."""

    name: str
    default: float | int | None = None

    def value(self, args: dict) -> float | int:
        got = args.get(self.name, self.default)
        if got is None or isinstance(got, bool) or not isinstance(got, (int, float)):
            raise ValueError(f"parameter {self.name!r} needs a number")
        return got


def _number(x, args: dict):
    return x.value(args) if isinstance(x, Param) else x


def _literal(x) -> tuple[Column, bool]:
    return (F.lit(x).cast("long"), True) if isinstance(x, int) else (F.lit(float(x)), False)


@dataclass(frozen=True)
class Slot:
    """An argument of a numeric function, by position."""

    index: int


@dataclass(frozen=True)
class Apply:
    """An operator over numbers, parameters, slots and other applications. - and / take two; + and * any number from two."""

    op: str
    parts: tuple

    def __post_init__(self):
        if self.op not in OPERATORS or len(self.parts) < 2 or self.op in "-/" and len(self.parts) != 2:
            raise ValueError(f"bad use of {self.op!r}")


def negate(x) -> Apply:
    return Apply("*", (x, -1))


def slots(expr) -> int:
    """How many arguments an expression takes."""
    if isinstance(expr, Slot):
        return expr.index + 1
    return max(map(slots, expr.parts), default=0) if isinstance(expr, Apply) else 0


def bind(expr, values: dict):
    """Partial application: slots given are replaced, the others move up to fill the gaps."""
    left = [i for i in range(slots(expr)) if i not in values]

    def walk(x):
        if isinstance(x, Slot):
            return values[x.index] if x.index in values else Slot(left.index(x.index))
        return Apply(x.op, tuple(map(walk, x.parts))) if isinstance(x, Apply) else x

    return walk(expr)


def evaluate(expr, inputs: list[tuple[Column, bool]], args: dict) -> tuple[Column, bool]:
    """(column, whether it's integral). Whole numbers stay whole: their division truncates, and overflow is an error."""
    if isinstance(expr, Slot):
        return inputs[expr.index]
    if not isinstance(expr, Apply):
        return _literal(_number(expr, args))

    def join(a, b):
        whole = a[1] and b[1]
        x, y = (c[0] if whole else c[0].cast("double") for c in (a, b))
        if expr.op == "/":
            return (F.call_function("div", x, y) if whole else x / y), whole
        return {"+": x + y, "-": x - y, "*": x * y}[expr.op], whole

    return reduce(join, (evaluate(p, inputs, args) for p in expr.parts))


@dataclass(frozen=True)
class RowFunc:
    """A number from a row: the cells numbered (1 is the first column, 0 the row number), through an expression or as it is."""

    columns: tuple[int, ...]
    expr: object = Slot(0)

    def __post_init__(self):
        if slots(self.expr) > len(self.columns):
            raise ValueError("the function takes more arguments than there are columns")

    def column(self, df: DataFrame, cells: list[str], args: dict, row: str = "row_no") -> tuple[Column, bool] | None:
        """None if a column isn't there or isn't numeric, as then it applies to no row."""
        inputs = []
        for n in self.columns:
            if not 0 <= n <= len(cells):
                return None
            name = row if n == ROW_NO else cells[n - 1]
            kind = df.schema[name].dataType
            if isinstance(kind, T.IntegralType):
                inputs.append((F.col(name).cast("long"), True))
            elif isinstance(kind, (T.FractionalType, T.DecimalType)):
                inputs.append((F.col(name).cast("double"), False))
            elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                from chainlake.functions.cells import utc_millis

                inputs.append((utc_millis(F.col(name), kind), True))
            else:
                return None
        return evaluate(self.expr, inputs, args)


@dataclass(frozen=True)
class Compare:
    """left op right, each a number, a parameter or a row function; one at least is a row function."""

    left: object
    op: str
    right: object

    def __post_init__(self):
        if self.op not in COMPARISONS or not (isinstance(self.left, RowFunc) or isinstance(self.right, RowFunc)):
            raise ValueError("a comparison needs a known operator and a row function")

    def condition(self, df, cells, args, row="row_no") -> Column:
        sides = [x.column(df, cells, args, row) if isinstance(x, RowFunc) else _literal(_number(x, args)) for x in (self.left, self.right)]
        if None in sides:
            return F.lit(False)
        a, b = (s[0] for s in sides)
        made = {"=": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[self.op]
        return F.coalesce(made, F.lit(False))


@dataclass(frozen=True)
class Branch:
    """AND or OR over two or more conditions."""

    op: str
    parts: tuple

    def __post_init__(self):
        if self.op not in ("AND", "OR") or len(self.parts) < 2:
            raise ValueError("a branch is AND or OR over at least two")

    def condition(self, df, cells, args, row="row_no") -> Column:
        made = [p.condition(df, cells, args, row) for p in self.parts]
        return reduce((lambda a, b: a & b) if self.op == "AND" else (lambda a, b: a | b), made)


def params(x) -> list[Param]:
    """All parameters, in order of appearance."""
    if isinstance(x, Param):
        return [x]
    parts = x.parts if isinstance(x, (Apply, Branch)) else (x.left, x.right) if isinstance(x, Compare) else (x.expr,) if isinstance(x, RowFunc) else ()
    return [p for part in parts for p in params(part)]


@dataclass(frozen=True)
class Query:
    """A filter over rows with named parameters; a name stands for one parameter only."""

    where: object
    params: tuple = field(init=False)

    def __post_init__(self):
        found = params(self.where)
        if len({p.name for p in found}) < len(set(found)) or len(set(found)) < len(found):
            raise ValueError("two parameters have one name")
        object.__setattr__(self, "params", tuple(found))

    def select(self, df: DataFrame, cells: list[str], args: dict | None = None, row: str = "row_no") -> DataFrame:
        return df.where(self.where.condition(df, cells, args or {}, row))


# The format's names are fixed values ---------------------------------------------------------------------------------


def parse_query(text: str, inputs: dict[str, dict] | None = None) -> Query:
    """From JSON: {"predTree": node}, or the node itself, or a whole template with objRefs.inputs and query."""
    spec = json.loads(text) if isinstance(text, str) else text
    known = dict((spec.get("objRefs") or {}).get("inputs") or {}) | (inputs or {})
    spec = spec.get("query", spec)
    return Query(_tree(spec.get("predTree", spec), known))


def _tree(node: dict, known: dict):
    if "sub" in node:
        return Branch(str(node["op"]).upper(), tuple(_tree(n, known) for n in node["sub"]))
    leaf = node.get("rowPredicate", node)
    side = lambda s: _row_func(leaf[f"{s}Func"], known) if f"{s}Func" in leaf else _value(leaf[f"{s}Num"], known)
    return Compare(side("left"), leaf["op"], side("right"))


def _value(x, known: dict):
    if isinstance(x, dict):
        spec = known.get(x["arg"]) or {}
        return Param(x["arg"], spec.get("default"))
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise ValueError(f"{x!r} is no number")
    return x


def _row_func(spec: dict, known: dict) -> RowFunc:
    cols = sorted(spec["funcRowCols"], key=lambda c: c["idx"])
    if [c["idx"] for c in cols] != list(range(len(cols))):
        raise ValueError("columns of a function are numbered from 0")
    return RowFunc(tuple(c["rcn"] for c in cols), _num_func(spec["func"], known) if "func" in spec else Slot(0))


def _num_func(spec: dict, known: dict):
    if "args" in spec:
        return bind(_num_func(spec["func"], known), {a["idx"]: _value(a["val"], known) for a in spec["args"]})
    count = iter(range(1 << 16))

    def walk(node):
        if "op" in node:
            return Apply(node["op"], tuple(walk(n) for n in node["sub"]))
        return Slot(next(count)) if node["val"] == "arg" else _value(node["val"], known)

    return walk(spec)


def query_json(query: Query) -> str:
    """The query as the JSON that parse_query() reads: a template with its parameters and its tree."""
    inputs = {p.name: {"type": "number"} | ({} if p.default is None else {"default": p.default}) for p in query.params}
    return json.dumps({"objRefs": {"inputs": inputs}, "query": {"predTree": _tree_spec(query.where)}})


def _tree_spec(node) -> dict:
    if isinstance(node, Branch):
        return {"op": node.op, "sub": [_tree_spec(p) for p in node.parts]}
    sides = {}
    for name, side in (("left", node.left), ("right", node.right)):
        if isinstance(side, RowFunc):
            sides[f"{name}Func"] = _row_func_spec(side)
        else:
            sides[f"{name}Num"] = _value_spec(side)
    return {"rowPredicate": sides | {"op": node.op}}


def _value_spec(x):
    return {"arg": x.name} if isinstance(x, Param) else x


def _row_func_spec(f: RowFunc) -> dict:
    # arguments are named by their place among the columns, so a column is listed as often as it is used
    used: list[int] = []

    def walk(x):
        if isinstance(x, Slot):
            used.append(f.columns[x.index])
            return {"val": "arg"}
        return {"op": x.op, "sub": [walk(p) for p in x.parts]} if isinstance(x, Apply) else {"val": _value_spec(x)}

    func = walk(f.expr)
    spec = {"funcRowCols": [{"idx": i, "rcn": c} for i, c in enumerate(used)]}
    return spec if "val" in func else spec | {"func": func}


# Sums and report tables ----------------------------------------------------------------------------------------------


def total(df: DataFrame, cells: list[str], what: RowFunc | int, *, result: object = Slot(0), args: dict | None = None, truncate: bool = True) -> DataFrame:
    """One row `total`: the sum over rows of a cell (by number) or a row function, through a last expression; null if no row has a
    number. As reports have it, a plain cell's values are truncated to whole numbers first, unless truncate is false."""
    plain = isinstance(what, int)
    made = (RowFunc((what,)) if plain else what).column(df, cells, args or {})
    if made is None:
        return df.sparkSession.createDataFrame([(None,)], "total double")
    value, whole = made
    if plain and truncate and not whole:
        value, whole = value.cast("long"), True
    summed = df.agg(F.sum(value).alias("_sum"))
    return summed.select(evaluate(result, [(F.col("_sum"), whole)], args or {})[0].alias("total"))


def formatted(kind: str, value: Column, *, pattern: str | None = None, prefix: str = "", postfix: str = "") -> Column:
    """Text of a cell: numbers by a decimal pattern ("#,##0.00", "0.###", "00%"), dates (UTC milliseconds or times) by a date pattern."""
    if kind == "number":
        text = F.call_function("format_number", value, F.lit(pattern)) if pattern else value.cast("string")
    elif kind == "date":
        text = F.date_format(F.timestamp_millis(value), pattern or "yyyy-MM-dd")
    else:
        text = value.cast("string")
    return F.when(value.isNotNull(), F.concat(F.lit(prefix), text, F.lit(postfix)))


def report_table(rows: DataFrame, templates: list[Column], *, order: str = "row_no", fixed: dict[int, str] | None = None) -> DataFrame:
    """(r, c, text): one table row a source row, a column for each template; `fixed` pins texts by cell index (r * width + c), negative
    ones counted from the end."""
    width = len(templates)
    numbered = number_rows(rows, [order], "_r").withColumn("_r", F.col("_r") - 1)
    cells = numbered.select(F.col("_r").cast("int").alias("r"), F.posexplode(F.array(*(t.cast("string") for t in templates))).alias("c", "text"))
    if not fixed:
        return cells
    n = numbered.count() * width
    pins = [((i + n if i < 0 else i) // width, (i + n if i < 0 else i) % width, t) for i, t in fixed.items() if -n <= i < n]
    if not pins:
        return cells
    pinned = rows.sparkSession.createDataFrame(pins, "r int, c int, pin string")
    return cells.join(F.broadcast(pinned), ["r", "c"], "left").select("r", "c", F.coalesce("pin", "text").alias("text"))
