"""Canned circuits: one input, the usual chains of nodes, one output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from deltaweave.operators.joins import Keys
from deltaweave.operators.zframe import Condition, ZFrame
from deltaweave.plans.circuit import Circuit, View


@dataclass
class Built:
    """A circuit with one input; ``output`` is its last node and takes sinks."""

    circuit: Circuit
    input: View
    output: View

    def step(self, delta: ZFrame) -> ZFrame:
        """The output's delta for one delta of the input."""
        return self.circuit.step({self.input.node: delta})[self.output.node]


def _begin(spark: SparkSession, schema: StructType | str) -> tuple[Circuit, View]:
    circuit = Circuit(spark)
    return circuit, circuit.input("input", schema)


def filter_query(spark: SparkSession, schema: StructType | str, condition: Condition) -> Built:
    circuit, rows = _begin(spark, schema)
    return Built(circuit, rows, rows.filter(condition))


def map_query(spark: SparkSession, schema: StructType | str, *expressions: Condition) -> Built:
    circuit, rows = _begin(spark, schema)
    return Built(circuit, rows, rows.map(*expressions))


def filter_map_query(spark: SparkSession, schema: StructType | str, condition: Condition, *expressions: Condition) -> Built:
    circuit, rows = _begin(spark, schema)
    return Built(circuit, rows, rows.filter(condition).map(*expressions))


def group_query(spark: SparkSession, schema: StructType | str, condition: Condition, keys: Keys, **measures: tuple[str, Condition | None]) -> Built:
    """Filtered rows' sums, counts and averages by key."""
    circuit, rows = _begin(spark, schema)
    return Built(circuit, rows, rows.filter(condition).group_sums(keys, **measures))
