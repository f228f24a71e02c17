"""Data-parallel training of small networks.

The training rows are dealt to as many buckets as there are tasks, in a random order, and
written once; every epoch is a job that reads each bucket as a stream of mini-batches.

* ``Schedule(exchange="epoch")``, the default: every task takes its own Adam steps from the
  common state, and weights and moments are averaged by rows after the epoch.
* ``Schedule(exchange="step")``: the tasks of an epoch run together (barrier execution); at each
  step all exchange the gradients of their mini-batches with ``allGather`` and take the
  same step on all of them together, which is what one process does on the joined
  mini-batches.  It needs a slot for every task and a cluster without dynamic allocation, and
  each exchange takes a second, as Spark's barrier looks for its answer once a second: for small
  tables and few, large steps.

With one task both are the same.  There are at most ``MAX_TASKS`` tasks, as averaging more
models (or exchanging more gradients) helps no further; up to that they grow with the rows.  A task
holds ``BUFFER`` items and the model; states of some 100 KB a task come back after each
epoch, so a lost executor costs the epoch at hand.

A holdout of ``validation_flag`` gives the validation loss of the weights at the start of each
epoch, in the same pass; training stops after ``patience`` epochs without a better one.
"""
from __future__ import annotations

import base64
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...config import RANDOM_STATE
from ...session import release, shared_path, ship_package, shuffles_dropped

MAX_TASKS = 64
#: Rows from which on another task pays.
ROWS_PER_TASK = 2_000
#: Items that are shuffled together.
BUFFER = 16_384
_BUCKETED = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
_OUT = "task int, n long, loss double, n_val long, state array<double>"


class Network(Protocol):
    """What the trainer needs of a model; sent to the tasks."""

    def initial(self, seed: int) -> np.ndarray:
        """Flat weights to begin with."""

    def items(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        """Parts of a batch: which items are held out, and arrays with an item in each row."""

    def gradient(self, weights: np.ndarray, items: tuple[np.ndarray, ...], rng: np.random.Generator) -> np.ndarray:
        """Gradient of the items' summed losses."""

    def losses(self, weights: np.ndarray, items: tuple[np.ndarray, ...]) -> np.ndarray:
        """The items' losses."""


@dataclass
class Adam:
    """Weights with their moments, as one flat state."""
    lr: float = 0.001

    def begin(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([weights, np.zeros(2 * len(weights) + 1)])

    def step(self, state: np.ndarray, g: np.ndarray) -> np.ndarray:
        (w, m, v), t = np.split(state[:-1], 3), state[-1] + 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - self.lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-7)
        return np.concatenate([w, m, v, [t]])


@dataclass
class Schedule:
    epochs: int = 50
    batch_size: int = 256
    patience: int = 5
    seed: int = RANDOM_STATE
    exchange: str = "epoch"
    adam: Adam = field(default_factory=Adam)


@dataclass
class Trained:
    weights: np.ndarray
    #: Validation loss of each epoch's weights, from those at the start.
    history: list[float]


def mini_batches(parts: Iterator[tuple[np.ndarray, ...]], size: int, rng: np.random.Generator, buffer: int = BUFFER) -> Iterator[tuple[np.ndarray, ...]]:
    """Items in random order within a buffer, ``size`` at a time; the last batch may be smaller."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def mixed(last: bool) -> Iterator[tuple[np.ndarray, ...]]:
        nonlocal held, n
        items = tuple(np.concatenate(a) for a in zip(*held, strict=True))
        order = rng.permutation(n)
        whole = n if last else n - n % size
        for a in range(0, whole, size):
            yield tuple(x[order[a: min(a + size, whole)]] for x in items)
        held, n = ([tuple(x[order[whole:]] for x in items)], n - whole) if whole < n else ([], 0)

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= buffer:
            yield from mixed(False)
    if n:
        yield from mixed(True)


def _told(n: int, g: np.ndarray | None) -> str:
    return f"{n}|{base64.b64encode(g.tobytes()).decode() if n else ''}"


def _heard(messages: list[str]) -> tuple[int, np.ndarray | None]:
    """Items and summed gradient of all tasks, in the order of the tasks."""
    total, g = 0, None
    for m in messages:
        n, data = m.split("|")
        if int(n):
            one = np.frombuffer(base64.b64decode(data))
            total, g = total + int(n), one.copy() if g is None else g + one
    return total, g


def _epoch(batches: Iterator[pa.RecordBatch], network: Network, plan: Schedule, epoch: int, state: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A pass over a task's rows; the one after the last epoch only measures."""
    together = plan.exchange == "step"
    context = BarrierTaskContext.get() if together else TaskContext.get()
    task, size = context.partitionId(), (len(state) - 1) // 3
    before, seen, loss, n_val = state[:size].copy(), 0, 0.0, 0
    rng = np.random.default_rng([plan.seed, epoch, task])

    def training() -> Iterator[tuple[np.ndarray, ...]]:
        nonlocal loss, n_val
        for batch in batches:
            for held, items in network.items(batch):
                if held.any():
                    loss += float(network.losses(before, tuple(x[held] for x in items)).sum())
                    n_val += int(held.sum())
                if epoch < plan.epochs and not held.all():
                    yield tuple(x[~held] for x in items)

    own = mini_batches(training(), plan.batch_size, rng)
    while True:
        items = next(own, None)
        n = total = 0 if items is None else len(items[0])
        g = network.gradient(state[:size], items, rng) if n else None
        if together:
            total, g = _heard(context.allGather(_told(n, g)))
        if not total:  # this task, or every task, has come to its end
            break
        seen += n
        state = plan.adam.step(state, g / total)
    told = None if together and task else state.tolist()
    yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([seen], pa.int64()), pa.array([loss]), pa.array([n_val], pa.int64()), pa.array([told], pa.list_(pa.float64()))], ["task", "n", "loss", "n_val", "state"])


@contextmanager
def _dealt(rows: DataFrame, key: list[str], tasks: int, seed: int) -> Iterator[DataFrame]:
    """``rows`` as a table whose scan has a partition a task, each in a random but fixed order."""
    spark = rows.sparkSession
    name = f"training_{uuid.uuid4().hex[:12]}"
    path, before = shared_path(spark, name), spark.conf.get(_BUCKETED, None)
    ordered = rows.withColumn("_order", F.xxhash64(*key, F.lit(seed)))
    dealt = ordered.repartition(tasks, *key).write.bucketBy(tasks, *key).sortBy("_order", *key)
    with shuffles_dropped(spark):
        dealt.option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    spark.conf.set(_BUCKETED, "false")  # else a scan without a join is cut by file size
    try:
        yield spark.table(name).drop("_order")
    finally:
        if before is None:
            spark.conf.unset(_BUCKETED)
        else:
            spark.conf.set(_BUCKETED, before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        release(spark, [path])


def tasks_for(spark: SparkSession, rows: int) -> int:
    return max(1, min(spark.sparkContext.defaultParallelism, MAX_TASKS, math.ceil(rows / ROWS_PER_TASK)))


def train(rows: DataFrame, key: list[str], network: Network, plan: Schedule, tasks: int | None = None) -> Trained:
    """``rows`` hold ``key`` and what ``network.items`` reads.  Without rows the initial weights stay."""
    spark = rows.sparkSession
    ship_package(spark)
    state = plan.adam.begin(network.initial(plan.seed))
    size = (len(state) - 1) // 3
    best, least, waited, history = state[:size], math.inf, 0, []
    with _dealt(rows, key, tasks or tasks_for(spark, rows.count()), plan.seed) as table:
        for epoch in range(plan.epochs + 1):  # the last one measures the weights of the one before it
            told = table.mapInArrow(lambda b, epoch=epoch, state=state: _epoch(b, network, plan, epoch, state), _OUT, barrier=plan.exchange == "step").collect()  # a row a task
            n_val = sum(r.n_val for r in told)
            history.append(sum(r.loss for r in told) / n_val if n_val else math.inf)
            if history[-1] < least or not n_val:
                best, least, waited = state[:size], history[-1], 0
            else:
                waited += 1
            if waited >= plan.patience or not sum(r.n for r in told):
                break
            ran = [r for r in sorted(told, key=lambda r: r.task) if r.state is not None and (r.n or plan.exchange == "step")]
            state = np.average([r.state for r in ran], axis=0, weights=[max(r.n, 1) for r in ran])
    return Trained(best, history)
