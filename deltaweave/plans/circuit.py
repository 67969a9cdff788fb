"""Circuits: named inputs, operator nodes and sinks, evaluated step by step.

A node is an incremental operator over earlier nodes. Every node has its own id, so equal
operators on one input never collide, and an input without a delta in a step has the empty one.
Nodes with several readers are cut, so they are computed once a step; a circuit's whole state can
be saved and restored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import Column, SparkSession
from pyspark.sql.types import StructType

from deltaweave.operators.joins import Keys
from deltaweave.operators.zframe import Condition, ZFrame
from deltaweave.plans import incremental as inc
from deltaweave.session import cut


class View:
    """A handle on a node; its methods add nodes."""

    def __init__(self, circuit: Circuit, node: str) -> None:
        self.circuit, self.node = circuit, node

    def _add(self, kind: str, operator, *others: View) -> View:
        return self.circuit.add(kind, operator, self, *others)

    def filter(self, condition: Condition) -> View:
        return self._add("filter", inc.Linear(lambda d: d.filter(condition)))

    def map(self, *expressions: Condition) -> View:
        return self._add("map", inc.Linear(lambda d: d.map(*expressions)))

    def flat_map(self, items: Condition, name: str, *keep: Condition) -> View:
        return self._add("flat_map", inc.Linear(lambda d: d.flat_map(items, name, *keep)))

    def union(self, other: View) -> View:
        return self._add("union", inc.Linear(lambda a, b: a.add(b)), other)

    def negate(self) -> View:
        return self._add("negate", inc.Linear(lambda d: d.negate()))

    def distinct(self) -> View:
        return self._add("distinct", inc.Distinct())

    def integrate(self) -> View:
        return self._add("integrate", inc.Integral())

    def differentiate(self) -> View:
        return self._add("differentiate", inc.Differential())

    def delay(self) -> View:
        return self._add("delay", inc.Delay())

    def join(self, other: View, left_keys: Keys, right_keys: Keys, where: Condition | None = None, select: Sequence[Condition] | None = None, append_only: bool = False) -> View:
        kind = inc.AppendOnlyJoin if append_only else inc.Join
        return self._add("join", kind(left_keys, right_keys, where, select), other)

    def semi_join(self, other: View, left_keys: Keys, right_keys: Keys) -> View:
        return self._add("semi_join", inc.semi_join(left_keys, right_keys), other)

    def anti_join(self, other: View, left_keys: Keys, right_keys: Keys) -> View:
        return self._add("anti_join", inc.anti_join(left_keys, right_keys), other)

    def outer_join(self, other: View, left_keys: Keys, right_keys: Keys, how: str) -> View:
        return self._add(f"{how}_join", inc.outer_join(left_keys, right_keys, how), other)

    def group_sums(self, keys: Keys, **measures: tuple[str, Condition | None]) -> View:
        return self._add("group_sums", inc.GroupSums(keys, **measures))

    def extremes(self, keys: Keys, **measures: tuple[str, Condition]) -> View:
        return self._add("extremes", inc.extremes(keys, **measures))

    def top_k(self, keys: Keys, order: Sequence[Column], k: int) -> View:
        return self._add("top_k", inc.top_k(keys, order, k))

    def count(self) -> View:
        """The total weight as one row ``count``, 0 for nothing."""
        return self._add("count", inc.GroupSums([], always=True, count=("count", None)))

    def sum(self, expression: Condition, name: str = "sum") -> View:
        """The weighted sum of an expression as one row, null without a value."""
        return self._add("sum", inc.GroupSums([], always=True, **{name: ("sum", expression)}))

    def query(self, function: Callable[..., ZFrame], *others: View) -> View:
        """Any query of whole tables, incrementalised."""
        return self._add("query", inc.Incrementalized(function, 1 + len(others)), *others)

    def output(self, callback: Callable[[ZFrame], None]) -> View:
        """Call back with this node's delta at the end of each step."""
        self.circuit.sinks.append((self.node, callback))
        return self


class Circuit(inc.Stateful):
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.inputs: dict[str, ZFrame] = {}
        self.nodes: dict[str, tuple[object, tuple[str, ...]]] = {}
        self.sinks: list[tuple[str, Callable[[ZFrame], None]]] = []
        self.steps = 0

    def input(self, name: str, schema: StructType | str) -> View:
        self.inputs[name] = ZFrame.zero(self.spark, schema)
        return View(self, name)

    def add(self, kind: str, operator, *sources: View) -> View:
        node = f"{kind}#{len(self.nodes)}"
        self.nodes[node] = operator, tuple(s.node for s in sources)
        return View(self, node)

    def step(self, deltas: dict[str, ZFrame]) -> dict[str, ZFrame]:
        """Run one step; returns every node's delta by id. Input deltas are read once each."""
        if unknown := set(deltas) - set(self.inputs):
            raise KeyError(f"no such input: {sorted(unknown)}")
        now = {name: ZFrame(cut(deltas[name].df)) if name in deltas else empty for name, empty in self.inputs.items()}
        readers = Counter(source for _, sources in self.nodes.values() for source in sources) + Counter(node for node, _ in self.sinks)
        for node in TopologicalSorter({n: s for n, (_, s) in self.nodes.items()}).static_order():
            if node in self.nodes:
                operator, sources = self.nodes[node]
                out = operator.step(*(now[s] for s in sources))
                now[node] = ZFrame(cut(out.df)) if readers[node] > 1 else out
        for node, callback in self.sinks:
            callback(now[node])
        self.steps += 1
        return now

    def reset(self) -> None:
        for operator, _ in self.nodes.values():
            operator.reset()
        self.steps = 0

    # -- survival ----------------------------------------------------------------------

    def parts(self) -> list:
        return [operator for operator, _ in self.nodes.values()]

    def save(self) -> dict:
        """Where all nodes' states are; to be restored into a circuit built the same way."""
        return {"steps": self.steps, "nodes": list(self.nodes), **super().save()}

    def restore(self, spark: SparkSession, saved: dict) -> None:
        if saved["nodes"] != list(self.nodes):
            raise ValueError("the saved state is of a circuit with other nodes")
        super().restore(spark, saved)
        self.steps = saved["steps"]


class Collected(inc.Stateful):
    """A sink that keeps the sum of the deltas it gets."""

    def __init__(self) -> None:
        self.integral = inc.Integral()

    def parts(self) -> list:
        return [self.integral]

    def __call__(self, delta: ZFrame) -> None:
        self.integral.step(delta)

    @property
    def table(self) -> ZFrame | None:
        return self.integral.state
