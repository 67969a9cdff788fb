"""SQL scripts of CREATE TABLE and CREATE VIEW, kept up to date incrementally.

Spark parses, analyses and runs the view text; this module only decides how a view reacts to
deltas, by the analysed plan:

* linear (projections, filters, UNION ALL, generators over each table once): the text runs on
  the inserted and on the deleted rows, and the results carry weights +1 and -1;
* joined (the same with inner and cross joins): linear in each table by itself, so the text runs
  on one table's delta and the other tables' states, table after table;
* grouped (GROUP BY, HAVING or global aggregates over a linear or joined FROM and WHERE): the text
  is split into keys and arguments, kept up to date as above, their aggregates by key, from
  mergeable partials or by recomputing touched keys only, and the SELECT list over these;
* outer (a LEFT, RIGHT, FULL, SEMI or ANTI join on equal columns, over two tables): the text runs
  on the rows with a touched key, before and after;
* anything else: the text runs on the tables before and after, and the results are subtracted.

A view that is not provably one of these always takes the last way, which is exact for every
query. Views may read earlier views.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from math import prod

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deltaweave.operators.zframe import W, ZFrame
from deltaweave.plans.incremental import ByKey, Differential, GroupSums, Integral, Stateful, measured
from deltaweave.plans.state import SMALL
from deltaweave.session import empty_frame, known_empty, measured_cut

#: DDL names that Spark spells differently; fixed values.
TYPE_NAMES = {"VARCHAR": "STRING", "TEXT": "STRING", "CHAR": "STRING", "INTEGER": "INT", "NUMBER": "DOUBLE", "REAL": "DOUBLE", "DATETIME": "TIMESTAMP", "BOOL": "BOOLEAN"}

_LEAVES = {"LogicalRelation", "LogicalRDD", "LocalRelation", "Range"}
_LINEAR = {"Project", "Filter", "SubqueryAlias", "View", "Union", "Generate", "ResolvedHint"} | _LEAVES
_VOLATILE = re.compile(r"\b(rand|randn|random|uuid|shuffle|now|current_timestamp|current_date|current_time|localtimestamp|monotonically_increasing_id|input_file_name)\b", re.I)


def split_statements(script: str) -> list[str]:
    """Statements between semicolons outside quotes and comments."""
    out, start, i, n = [], 0, 0, len(script)
    while i < n:
        c = script[i]
        if c in "'\"`":
            i += 1
            while i < n and script[i] != c:
                i += 2 if script[i] == "\\" and c != "`" else 1
        elif script.startswith("--", i):
            i = script.find("\n", i) if "\n" in script[i:] else n - 1
        elif script.startswith("/*", i):
            i = script.find("*/", i) + 1 if "*/" in script[i:] else n - 1
        elif c == ";":
            out.append(script[start:i])
            start = i + 1
        i += 1
    out.append(script[start:])
    return [s.strip() for s in out if s.strip()]


def parse_columns(body: str) -> str:
    """A Spark DDL schema from the columns of a CREATE TABLE; constraints are dropped."""
    parts, depth, word = [], 0, ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(word)
            word = ""
        else:
            word += c
    fields = []
    for part in (*parts, word):
        if re.match(r"\s*(PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|KEY|INDEX|CHECK)\b", part, re.I):
            continue
        found = re.match(r"\s*[`\"]?(\w+)[`\"]?\s+(\w+)\s*(\([^)]*\))?", part)
        if not found:
            raise ValueError(f"cannot read the column {part.strip()!r}")
        name, kind, size = found[1], found[2].upper(), found[3] or ""
        kind = TYPE_NAMES.get(kind, kind)
        fields.append(f"`{name}` {kind}{size if kind == 'DECIMAL' else ''}")
    return ", ".join(fields)


@dataclass
class ViewPlan:
    name: str
    text: str
    sources: list[str] = field(default_factory=list)
    strategy: str = "recompute"
    difference: Differential = field(default_factory=Differential)
    grouped: Grouped | None = None
    outer: ByKey | None = None


@dataclass
class Grouped:
    """A grouped view's parts: the text of keys and arguments, the aggregates by key, and the
    view's own list over them."""

    inner: str
    inner_strategy: str
    operator: object
    final: str


class SqlViews(Stateful):
    """A compiled script. ``step`` takes deltas of its tables and returns deltas of its views."""

    marks = ("retracted",)

    def __init__(self, spark: SparkSession, script: str) -> None:
        self.spark, self.tables, self.views = spark, {}, {}
        self.prefix = f"v{uuid.uuid4().hex[:12]}_"
        statements = split_statements(script)
        for text in statements:
            if found := re.match(r"CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?(\w+)[`\"]?\s*\((.*)\)\s*$", text, re.I | re.S):
                self.tables[found[1]] = spark.createDataFrame([], parse_columns(found[2])).schema
            elif not re.match(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?VIEW\b", text, re.I):
                raise ValueError(f"only CREATE TABLE and CREATE VIEW are compiled, not {text[:60]!r}")
        self.integrals = {name: Integral() for name in self.tables}
        #: Tables of which rows have been taken back.
        self.retracted: list[str] = []
        schemas: dict[str, StructType] = dict(self.tables)
        for text in statements:
            if found := re.match(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?VIEW\s+[`\"]?(\w+)[`\"]?\s+AS\s+(.*)$", text, re.I | re.S):
                view = ViewPlan(found[1], found[2])
                self.schemas = schemas
                empty = self._empty(view.text)
                view.sources, view.strategy = self._classify(empty, view.text)
                if view.strategy == "recompute":
                    self._group(view, empty) or self._outer(view, empty)
                schemas[view.name] = empty.schema
                self.views[view.name] = view
                self.integrals[view.name] = Integral()
        self.schemas = schemas

    def parts(self) -> list:
        operators = [p for v in self.views.values() for p in (v.difference, v.grouped and v.grouped.operator, v.outer) if p is not None]
        return [*self.integrals.values(), *operators]

    def reset(self) -> None:
        for part in self.parts():
            part.reset()
        self.retracted = []

    def _run(self, text: str, tables: dict[str, DataFrame]) -> DataFrame:
        """The text over the given tables; names are private, so scripts do not meet."""
        names = {}
        for name, df in tables.items():
            names[name.lower()] = private = f"{self.prefix}{uuid.uuid4().hex[:8]}_{name}"
            df.createOrReplaceTempView(private)
        try:
            return self.spark.sql(_rename(text, names))
        finally:
            for private in names.values():
                self.spark.catalog.dropTempView(private)

    def _empty(self, text: str) -> DataFrame:
        return self._run(text, {n: self.spark.createDataFrame([], s) for n, s in self.schemas.items()})

    def _classify(self, empty: DataFrame, text: str) -> tuple[list[str], str]:
        words = re.findall(r"\w+", _without_strings(text).lower())
        sources = [n for n in self.schemas if n.lower() in words]
        plan = empty._jdf.queryExecution().analyzed()
        kinds = {node.nodeName() for node in _nodes(plan)}
        joins = {node.joinType().toString() for node in _nodes(plan) if node.nodeName() == "Join"}
        bare = _without_strings(text)
        once = len(re.findall(r"\bfrom\b|\bjoin\b", bare, re.I)) == len(sources) and sum(words.count(n.lower()) > 1 and _reads(bare, n) > 1 for n in sources) == 0
        alone = sum(node.nodeName() in _LEAVES for node in _nodes(plan)) == len(sources)
        plain = not plan.subqueriesAll().size() and not _VOLATILE.search(text)
        if plain and once and kinds <= _LINEAR:
            return sources, "linear"
        if plain and alone and kinds <= _LINEAR | {"Join"} and joins <= {"Inner", "Cross"}:
            return sources, "joined"
        return sources, "recompute"

    def _group(self, view: ViewPlan, empty: DataFrame) -> bool:
        """Split an aggregating view, if its text has the form for it."""
        if (split := split_grouped(view.text, empty.columns)) is None or _VOLATILE.search(view.text):
            return False
        inner, keys, measures, final = split
        try:
            rows = self._empty(inner)
        except AnalysisException:  # names that mean something else outside the whole text
            return False
        sources, strategy = self._classify(rows, inner)
        kinds = dict(rows.dtypes)
        mergeable = all(kind in ("count", "sum", "avg") and not (kind == "avg" and kinds[f"_a{k}"].startswith("decimal")) for k, (kind, star) in enumerate(measures) if not star)
        if strategy == "recompute" or not (keys or mergeable):
            return False
        if mergeable:
            operator = GroupSums(keys, always=not keys, **{f"_m{k}": (kind, None if star else f"_a{k}") for k, (kind, star) in enumerate(measures)})
        else:
            operator = ByKey(lambda z: ZFrame.of(z.bag().groupBy(*keys).agg(*(F.expr(f"{kind}({'*' if star else f'_a{k}'})").alias(f"_m{k}") for k, (kind, star) in enumerate(measures)))), keys)
        try:
            out = self._run(final, {"_groups": _summary(operator, rows, keys, measures)})
        except AnalysisException:
            return False
        if len(out.columns) != len(empty.columns) or any(n.nodeName() not in _LINEAR for n in _nodes(out._jdf.queryExecution().analyzed())):
            return False
        view.grouped, view.strategy, view.sources = Grouped(inner, strategy, operator, final), "grouped", sources
        return True

    def _outer(self, view: ViewPlan, empty: DataFrame) -> bool:
        """One outer, semi or anti join of two tables on equal columns."""
        plan = empty._jdf.queryExecution().analyzed()
        joins = [n for n in _nodes(plan) if n.nodeName() == "Join"]
        leaves = sum(n.nodeName() in _LEAVES for n in _nodes(plan))
        found = re.search(r"\bON\s+\(?\s*(?:(\w+)\.)?(\w+)\s*=\s*(?:(\w+)\.)?(\w+)\s*\)?\s*(?=$|\bWHERE\b)", _without_strings(view.text), re.I)
        if len(joins) != 1 or leaves != 2 or len(view.sources) != 2 or not found or plan.subqueriesAll().size() or _VOLATILE.search(view.text):
            return False
        if {n.nodeName() for n in _nodes(plan)} - _LINEAR - {"Join"}:
            return False
        keys = {}
        for column in (found[2], found[4]):
            owners = [n for n in view.sources if column.lower() in [c.lower() for c in self.schemas[n].names]]
            if len(owners) != 1:
                return False
            keys[owners[0]] = column
        if len(keys) != 2:
            return False
        names = list(keys)
        if self.schemas[names[0]][keys[names[0]]].dataType != self.schemas[names[1]][keys[names[1]]].dataType:
            return False
        view.sources, view.strategy = names, "outer"
        view.outer = ByKey(lambda *zs: ZFrame.of(self._run(view.text, {n: z.bag() for n, z in zip(names, zs, strict=True)})), *keys.values())
        return True

    def _linear(self, text: str, sources: list[str], plus: dict[str, DataFrame], minus: dict[str, DataFrame]) -> ZFrame:
        return ZFrame.of(self._run(text, {s: plus[s] for s in sources})).subtract(ZFrame.of(self._run(text, {s: minus[s] for s in sources})))

    def _joined(self, text: str, sources: list[str], plus: dict[str, DataFrame], minus: dict[str, DataFrame]) -> ZFrame:
        """Table after table: its delta with the states after the step of the tables before it,
        and before the step of those after it. States need not be consolidated: what was put in
        counts for the text once, and what was taken back against it."""

        def signed(name: str, state: ZFrame | None) -> list[tuple[DataFrame, int]]:
            if state is None:
                return []
            out = [(_repeat(state.df.where(F.col(W) > 0)), 1)]
            return [*out, (_repeat(state.negate().df.where(F.col(W) > 0)), -1)] if name in self.retracted else out

        terms: list[ZFrame] = []
        for k, name in enumerate(sources):
            delta = [(df, sign) for df, sign in ((plus[name], 1), (minus[name], -1)) if not known_empty(df)]
            others = []
            for j, other in enumerate(sources):
                if j < k:
                    held = signed(other, self.integrals[other].state)
                elif j > k:
                    held = signed(other, self.before[other])
                else:
                    held = delta
                others.append([(other, df, sign) for df, sign in held])
            for combination in product(*others):
                rows = ZFrame.of(self._run(text, {n: df for n, df, _ in combination}))
                terms.append(rows if prod(sign for *_, sign in combination) > 0 else rows.negate())
        if not terms:
            return ZFrame.of(empty_frame(self.spark, self._empty(text).schema))
        return reduce(ZFrame.add, terms)

    def step(self, deltas: dict[str, ZFrame]) -> dict[str, ZFrame]:
        """Deltas of all views; tables without one have the empty delta."""
        if unknown := set(deltas) - set(self.tables):
            raise KeyError(f"no such table: {sorted(unknown)}")
        self.before = {name: i.state for name, i in self.integrals.items()}
        now: dict[str, ZFrame] = {}
        plus, minus = {}, {}

        def take(name: str, delta: ZFrame) -> None:
            now[name], size = measured(delta)
            plus[name], some = measured_cut(_repeat(now[name].df.where(F.col(W) > 0)))
            minus[name], less = measured_cut(_repeat(now[name].negate().df.where(F.col(W) > 0)))
            plus[name], minus[name] = (F.broadcast(df) if 0 < n <= SMALL else empty_frame(self.spark, df.schema) if n == 0 else df for df, n in ((plus[name], some), (minus[name], less)))
            if less and name not in self.retracted:
                self.retracted.append(name)
            self.integrals[name].add(now[name], size)

        for name, schema in self.tables.items():
            take(name, deltas.get(name) or ZFrame.zero(self.spark, schema))
        out = {}
        for name, view in self.views.items():
            ways = {"linear": self._linear, "joined": self._joined}
            if view.strategy in ways:
                delta = ways[view.strategy](view.text, view.sources, plus, minus)
            elif view.strategy == "grouped":
                groups = view.grouped.operator.step(ways[view.grouped.inner_strategy](view.grouped.inner, view.sources, plus, minus))
                gained, lost = (self._run(view.grouped.final, {"_groups": part.df.where(F.col(W) > 0).drop(W)}) for part in (groups, groups.negate()))
                delta = ZFrame.of(_as(gained, self.schemas[name])).subtract(ZFrame.of(_as(lost, self.schemas[name])))
            elif view.strategy == "outer":
                delta = view.outer.step(*(now[s] for s in view.sources))
            else:
                whole = self._run(view.text, {s: (self.integrals[s].state or ZFrame.zero(self.spark, self.schemas[s])).bag() for s in view.sources})
                delta = view.difference.step(ZFrame.of(whole))
            take(name, delta)
            out[name] = now[name]
        return out

    def table(self, name: str) -> ZFrame:
        """What a table or view holds now."""
        return self.integrals[name].state or ZFrame.zero(self.spark, self.schemas[name])


def _nodes(plan) -> list:
    """All nodes of a logical plan."""
    out, todo = [], [plan]
    while todo:
        out.append(node := todo.pop())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def _reads(text: str, name: str) -> int:
    """How often a text without strings reads a table."""
    return len(re.findall(rf"(?:\\b(?:FROM|JOIN)\\s+|,\\s*)[`\"]?{name}\\b(?!\\s*\\.)", text, re.I))


def _repeat(rows: DataFrame) -> DataFrame:
    """Rows of positive weight as plain rows, each as often as it weighs."""
    return rows.withColumn(W, F.explode(F.sequence(F.lit(1).cast("long"), F.col(W)))).drop(W)


def _as(rows: DataFrame, schema: StructType) -> DataFrame:
    """Columns by place under the names and types of a schema."""
    return rows.toDF(*(f"c{k}" for k in range(len(schema)))).select(*(F.col(f"c{k}").cast(f.dataType).alias(f.name) for k, f in enumerate(schema)))


def _summary(operator, rows: DataFrame, keys: list[str], measures: list[tuple[str, bool]]) -> DataFrame:
    """An empty table of groups, for the analysis of the list over them."""
    plain = rows.groupBy(*keys).agg(*(F.expr(f"{kind}({'*' if star else f'_a{k}'})").alias(f"_m{k}") for k, (kind, star) in enumerate(measures)))
    return rows.sparkSession.createDataFrame([], plain.schema)


_CLAUSES = re.compile(r"\b(SELECT|FROM|WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|UNION|INTERSECT|EXCEPT|MINUS|WINDOW|QUALIFY|DISTINCT|LATERAL|WITH|OVER|FILTER|ROLLUP|CUBE|GROUPING)\b", re.I)
_AGGREGATE = re.compile(r"\b(count|sum|avg|min|max)\s*\(", re.I)


def _closing(text: str, start: int) -> int:
    """The place of the bracket that closes the one at ``start``."""
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    raise ValueError("a bracket is not closed")


def _items(text: str) -> list[str]:
    """What stands between commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in (*out, text[start:])]


def split_grouped(text: str, names: list[str]) -> tuple[str, list[str], list[tuple[str, bool]], str] | None:
    """Of ``SELECT list FROM .. [WHERE ..] [GROUP BY ..] [HAVING ..]``: the text of keys ``_g0, ..``
    and arguments ``_a0, ..``, the keys, (function, is it of ``*``) of each aggregate, and the
    list over a table ``_groups`` of keys and aggregates ``_m0, ..``. None for other forms."""
    strings: list[str] = []
    hidden = _STRINGS.sub(lambda m: strings.append(m[0]) or f"\x00{len(strings) - 1}\x00", text).strip()
    if "--" in hidden or "/*" in hidden:
        return None
    places = [(m.start(), m.end(), re.sub(r"\s+", " ", m[1].upper())) for m in _CLAUSES.finditer(hidden)]
    order = [p for *_, p in places]
    if order not in [["SELECT", "FROM", *w, *g, *h] for w in ([], ["WHERE"]) for g in ([], ["GROUP BY"]) for h in ([], ["HAVING"])] or places[0][0] != 0:
        return None
    ends = [a for a, *_ in places[1:]] + [len(hidden)]
    part = {p: hidden[b:e].strip() for (_, b, p), e in zip(places, ends, strict=True)}
    selected = [re.match(r"(.*?)(?:\s+AS\s+[`\"]?\w+[`\"]?)?$", x, re.I | re.S)[1].strip() for x in _items(part["SELECT"])]
    if len(selected) != len(names) or any("*" == x or x.endswith(".*") for x in selected):
        return None
    keys = [selected[int(x) - 1] if x.isdigit() and 0 < int(x) <= len(selected) else x for x in _items(part.get("GROUP BY", ""))] if "GROUP BY" in part else []
    arguments: list[tuple[str, str]] = []

    def over_groups(expression: str) -> str:
        out, at = "", 0
        while found := _AGGREGATE.search(expression, at):
            close = _closing(expression, found.end() - 1)
            argument = expression[found.end() : close].strip()
            if _AGGREGATE.search(argument):
                raise ValueError("an aggregate inside another")
            call = (found[1].lower(), argument)
            if call not in arguments:
                arguments.append(call)
            out += expression[at : found.start()] + f"_m{arguments.index(call)}"
            at = close + 1
        out += expression[at:]
        for k in sorted(range(len(keys)), key=lambda k: -len(keys[k])):
            out = re.sub(rf"(?<![\w.]){re.escape(keys[k])}(?![\w.(])", f"_g{k}", out, flags=re.I)
        return out

    try:
        chosen, having = [over_groups(x) for x in selected], over_groups(part.get("HAVING", ""))
    except ValueError:
        return None
    if not arguments or any("," in _without_brackets(a) for _, a in arguments):
        return None
    shown = lambda x: re.sub("\x00(\\d+)\x00", lambda m: strings[int(m[1])], x)
    source = f"FROM {part['FROM']}" + (f" WHERE {part['WHERE']}" if "WHERE" in part else "")
    held = [f"({x}) AS _g{k}" for k, x in enumerate(keys)] + [f"({x}) AS _a{k}" for k, (_, x) in enumerate(arguments) if x != "*"]
    inner = f"SELECT {', '.join(held) or '1 AS _one'} {source}"
    final = f"SELECT {', '.join(f'({x}) AS c{k}' for k, x in enumerate(chosen))} FROM _groups" + (f" WHERE {having}" if having else "")
    return shown(inner), [f"_g{k}" for k in range(len(keys))], [(f, x == "*") for f, x in arguments], shown(final)


def _without_brackets(text: str) -> str:
    while (less := re.sub(r"\([^()]*\)", "", text)) != text:
        text = less
    return text


_STRINGS = re.compile(r"'(?:[^'\\]|\\.|'')*'")


def _without_strings(text: str) -> str:
    return _STRINGS.sub("''", text)


def _rename(text: str, names: dict[str, str]) -> str:
    """Table names after FROM, JOIN and commas of a FROM list, outside strings; a renamed table
    keeps its old name as alias where the text gives none."""
    kept: list[str] = []
    hidden = _STRINGS.sub(lambda m: kept.append(m[0]) or f"\x00{len(kept) - 1}\x00", text)
    reserved = r"(?!(?:ON|USING|WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|INTERSECT|EXCEPT|MINUS|INNER|LEFT|RIGHT|FULL|CROSS|JOIN|NATURAL|SEMI|ANTI|LATERAL|WINDOW|TABLESAMPLE|PIVOT|UNPIVOT|SORT|CLUSTER|DISTRIBUTE)\b)"

    def swap(m: re.Match[str]) -> str:
        private = names.get(m[2].lower())
        if private is None:
            return m[0]
        alias = m[3] or ""
        return f"{m[1]}{private}{alias or f' AS {m[2]}'}"

    pattern = re.compile(rf"(\b(?:FROM|JOIN)\s+|,\s*)[`\"]?(\w+)[`\"]?(\s+(?:AS\s+)?{reserved}[A-Za-z_]\w*)?(?=\s|,|;|\)|$)", re.I)
    out, pos = [], 0
    # commas count only inside FROM lists: from FROM to the next clause
    clause = re.compile(r"\b(?:FROM|JOIN)\b.*?(?=\b(?:WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|INTERSECT|EXCEPT|MINUS|SELECT)\b|$)", re.I | re.S)
    for m in clause.finditer(hidden):
        out.append(hidden[pos : m.start()])
        out.append(pattern.sub(swap, m[0]))
        pos = m.end()
    out.append(hidden[pos:])
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], "".join(out))
