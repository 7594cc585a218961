"""Programs of ticks: rules that deduce now, insert or delete at the next tick, or send.

State is a set of relations, one Parquet version for each tick, so a batch that is run again after a failure starts
from the same state and gives the same one.  In a stream each micro-batch is a tick.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import datalog
from ..plans.compile import query
from ..plans.datalog import Program, Rule


@dataclass
class TickProgram:
    """now: rules to fixpoint within a tick; insert, delete: rules for the next tick's state; send: rules whose facts go
    out; state: the schema of each carried relation; inputs, outputs: names of devices, where given.  A device's rows
    come in or go out only: no rule makes an input's facts, and only send makes an output's, which no rule reads."""

    state: dict[str, T.StructType]
    now: list[Rule] = field(default_factory=list)
    insert: list[Rule] = field(default_factory=list)
    delete: list[Rule] = field(default_factory=list)
    send: list[Rule] = field(default_factory=list)
    merges: dict[str, str] = field(default_factory=dict)
    inputs: set[str] = field(default_factory=set)
    outputs: set[str] = field(default_factory=set)

    def check(self) -> None:
        for r in [*self.now, *self.insert, *self.delete, *self.send]:
            read = {n for f in r.body for n, _ in datalog._used(f)}
            if r.head.name in self.inputs or r.head.name in self.outputs and r not in self.send or read & self.outputs:
                raise ValueError(f"a device on the wrong side of a rule: {r}")


@dataclass
class Tick:
    state: dict[str, DataFrame]
    sent: dict[str, DataFrame]
    facts: dict[str, DataFrame]


def tick(program: TickProgram, state: Mapping[str, DataFrame], inputs: Mapping[str, DataFrame], spark: SparkSession) -> Tick:
    """One tick: what was deduced, what is sent, and the state of the next one ((state less deleted) plus inserted)."""
    program.check()
    facts = datalog.run(Program(program.now, program.merges), {**state, **inputs}, spark)

    def made(rules: list[Rule]) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for r in rules:
            rows = datalog._apply(r, facts, spark, bag=False)
            out[r.head.name] = out[r.head.name].union(rows).distinct() if r.head.name in out else rows
        return out

    more, less = made(program.insert), made(program.delete)
    after = {}
    for name, schema in program.state.items():
        rows = state[name]
        if name in less:
            rows = rows.subtract(less[name].toDF(*schema.names))
        if name in more:
            rows = rows.union(more[name].toDF(*schema.names)).distinct()
        after[name] = rows
    return Tick(after, made(program.send), facts)


class Process:
    """A tick program with its state in a folder: one version for each tick."""

    def __init__(self, program: TickProgram, path: str, spark: SparkSession):
        self.program, self.path, self.spark = program, path.rstrip("/"), spark

    def state(self, version: int) -> dict[str, DataFrame]:
        if version < 0:
            return {n: self.spark.createDataFrame([], s) for n, s in self.program.state.items()}
        return {n: self.spark.read.schema(s).parquet(f"{self.path}/{version}/{n}") for n, s in self.program.state.items()}

    def step(self, version: int, inputs: Mapping[str, DataFrame], emit: Callable[[str, DataFrame, int], None] | None = None) -> None:
        """Run tick `version`; running it again overwrites its results with the same ones."""
        done = tick(self.program, self.state(version - 1), inputs, self.spark)
        for name, rows in done.state.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{version}/{name}")
        if emit:
            for name, rows in done.sent.items():
                emit(name, rows, version)

    def branch(self, version: int, path: str) -> Process:
        """A process of its own that goes on from a version of this one, as its version -1 + 1."""
        other = Process(self.program, path, self.spark)
        for name, rows in self.state(version).items():
            rows.write.mode("overwrite").parquet(f"{path}/0/{name}")
        return other

    def modify(self, program: TickProgram) -> Process:
        """The same data under another program with the same state."""
        if program.state != self.program.state:
            raise ValueError("the state's schema differs")
        return Process(program, self.path, self.spark)

    def move(self, path: str) -> Process:
        """The process with all its versions in another folder."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.rename(at(self.path), at(path)):
            raise RuntimeError(f"{self.path} cannot be moved to {path}")
        return Process(self.program, path, self.spark)

    def merge(self, version: int, other: Process, other_version: int, path: str) -> Process:
        """A process of its own that goes on from the states of two, their relations united, as its version 0."""
        if other.program.state != self.program.state:
            raise ValueError("the state's schema differs")
        theirs = other.state(other_version)
        for name, rows in self.state(version).items():
            rows.union(theirs[name]).distinct().write.mode("overwrite").parquet(f"{path}/0/{name}")
        return Process(self.program, path, self.spark)

    def query(self, version: int, names: list[str], formula) -> DataFrame:
        """Answers over the state of a version."""
        return query(names, formula, self.state(version), self.spark)

    def start(self, stream: DataFrame, name: str, checkpoint: str, emit: Callable[[str, DataFrame, int], None] | None = None, **trigger):
        """Run on a stream: each micro-batch is a tick with its rows as the input relation `name`."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.step(batch, {name: rows.distinct()}, emit)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def quorum(votes: DataFrame, by: list[str], voter: str, least: int) -> DataFrame:
    """Keys with at least `least` different voters."""
    return votes.groupBy(*by).agg(F.countDistinct(voter).alias("voters")).filter(F.col("voters") >= least)


def stream_quorum(votes: DataFrame, by: list[str], voter: str, least: int) -> DataFrame:
    """The same on a stream: each vote counts once, in update mode."""
    return votes.dropDuplicates([*by, voter]).groupBy(*by).agg(F.count("*").alias("voters")).filter(F.col("voters") >= least)
