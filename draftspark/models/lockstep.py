"""Iterative training in one Spark stage.

A training step needs a little global information (a histogram, a gradient) and
then works on its rows again.  As separate jobs these steps cost a job each; here
the rows stay in their task for the whole training: a program is a generator that
yields the array its own rows contribute and is sent the arrays of all row
shards.  With one shard nothing is exchanged, and programs on few rows take their
steps together, as a step of few rows is mostly the calls it makes.  With more, the stage is a barrier
stage and the arrays travel by ``allGather``; they are as large as the model's
histograms, whatever the number of rows.  Spark takes about a second for each
exchange, so the programs of a stage advance together: exchanges grow with rounds
times levels, not with models.  Programs on the same rows are dealt out
to groups, each a task of its own; an executor that is lost has its group (in a
barrier stage: the stage) run again from the written rows.
"""

from __future__ import annotations

import base64
import os
import pickle
import tempfile
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one fold that a task holds (about 100 bytes each); more rows take more shards.
SHARD_ROWS = 250_000
#: Programs that advance together in a stage of several shards.
WAVE = 64

#: What a task holds in memory of its rows, or of another large array; more is held in a file of its executor.
HELD_BYTES = 192_000_000

Program = Generator[np.ndarray, list, object]


def _own_file():
    """A file in the executor's local folder whose name goes when it is closed; what is mapped from it stays."""
    return tempfile.NamedTemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0])


def array_held(n: int, columns: int) -> np.ndarray:
    """(n x columns) numbers, in a file if they are many."""
    if n * columns * 8 <= HELD_BYTES:
        return np.empty((n, columns))
    with _own_file() as f:
        return np.asarray(np.memmap(f, np.float64, "w+", shape=(n, columns)))


def rows_held(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The batches as a table; if they are large, its columns are mapped from a file."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > HELD_BYTES:
            break
    if size <= HELD_BYTES:
        return pa.Table.from_batches(held).combine_chunks() if held else None
    with _own_file() as f:
        with pa.ipc.new_stream(pa.PythonFile(f, "w"), held[0].schema) as writer:
            while held:
                writer.write_batch(held.pop(0))
            for batch in batches:
                writer.write_batch(batch)
        f.flush()
        return pa.ipc.open_stream(pa.memory_map(f.name)).read_all()


class Joint:
    """A step on a program's own rows that is cheaper for several programs at once:
    ``run`` takes the waiting steps of the same ``key`` and gives a result for each."""

    key: tuple

    @staticmethod
    def run(steps: list) -> list:
        raise NotImplementedError


def drive(programs: dict, exchange: Callable | None = None, together: int = 1) -> Iterator[tuple[object, object]]:
    """(name, result) of each program, in order.  ``exchange`` takes the arrays
    that a wave yields and returns those of all shards; none: a single shard, where
    ``together`` programs advance side by side to share their joint steps."""
    names = list(programs)
    wave = WAVE if exchange else max(1, together)
    for a in range(0, len(names), wave):
        live, asked, done = {}, {}, {}

        def advance(name, answer) -> None:
            try:
                asked[name] = live[name].send(answer)
                while exchange is None and not isinstance(asked[name], Joint):
                    asked[name] = live[name].send([asked[name]])
            except StopIteration as end:
                done[name] = end.value
                del live[name]
                asked.pop(name, None)

        for name in names[a:a + wave]:
            live[name] = programs[name]()
            advance(name, None)
        while live:
            joint: dict = {}
            for name, step in asked.items():
                if isinstance(step, Joint):
                    joint.setdefault(step.key, []).append(name)
            for own in joint.values():
                for name, answer in zip(own, asked[own[0]].run([asked[x] for x in own]), strict=True):
                    advance(name, answer)
            if not joint:
                order = list(live)
                shards = exchange([asked[name] for name in order])
                for i, name in enumerate(order):
                    advance(name, [shard[i] for shard in shards])
        yield from ((name, done[name]) for name in names[a:a + wave])


def shards_for(rows: DataFrame, largest: int) -> int:
    """Row shards for folds of at most ``largest`` rows; a barrier stage needs
    all its tasks at once, so never more than the session has slots."""
    return max(1, min(-(-largest // SHARD_ROWS), rows.sparkSession.sparkContext.defaultParallelism))


def in_lockstep(rows: DataFrame, work: Callable, schema: str, groups: int, shards: int) -> DataFrame:
    """Run ``work(table, group, drive, shard)`` for every group and row shard over
    the rows with that ``group`` (int column); it runs its programs by
    ``drive({name: make}, together)`` and yields output rows as dicts.  ``rows`` has a long
    ``key`` that deals its rows out to shards."""
    place = F.col("group") * shards + F.pmod(F.xxhash64("key"), F.lit(shards))
    dealt = rows.repartitionById(groups * shards, place.cast("int"))
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows_held(batches)
        task = (BarrierTaskContext if shards > 1 else TaskContext).get()
        group, shard = divmod(task.partitionId(), shards)

        def exchange(arrays: list) -> list:
            sent = task.allGather(base64.b64encode(pickle.dumps(arrays, protocol=5)).decode())
            return [pickle.loads(base64.b64decode(s)) for s in sent]

        out = []
        for row in work(table, group, lambda programs, together=1: drive(programs, exchange if shards > 1 else None, together), shard):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return dealt.mapInArrow(run, schema, barrier=shards > 1)
