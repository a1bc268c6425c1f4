"""Dense files written by tasks: stretches of equal length, in order, each made where its cells are.

Cells are brought together by blocks of successive stretches; a task writes each of its blocks as a file of its own, and what tasks return says where these are and how long
each stretch became. The driver gets these numbers, never cells, and appends the blocks to the head of the file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Location, join, make_folder, place, remove_folder

_CHUNK = 1 << 20


def write_blocks(cells: DataFrame, stretches: int, width: int, encode: Callable[[np.ndarray], bytes], folder: Location) -> list[tuple[str, list[int]]]:
    """Path and lengths of the stretches of each block, in order. ``cells``: stretch (long), at (int, its place in the stretch), value (double), each place once.

    ``encode`` makes bytes of a stretch's values (``width`` of them, NaN where there is no cell), also of stretches without cells. A file that a failed task leaves isn't named."""
    spark = cells.sparkSession
    blocks = max(1, min(stretches, 4 * spark.sparkContext.defaultParallelism))
    every = spark.range(stretches).select(F.col("id").alias("stretch"), F.lit(-1).alias("at"), F.lit(None).cast("double").alias("value"))
    rows = cells.select(F.col("stretch").cast("long").alias("stretch"), F.col("at").cast("int").alias("at"), F.col("value").cast("double").alias("value")).union(every)
    block = F.floor(F.col("stretch") * F.lit(blocks) / F.lit(stretches)).cast("int")
    sorted_ = rows.withColumn("block", block).repartition(blocks, "block").sortWithinPartitions("block", "stretch")
    where = str(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = place(where)[0]
        now, name, f, lengths, values = (-1, -1), "", None, [], np.full(width, np.nan)

        def ended(last: bool) -> Iterator[pa.RecordBatch]:
            if f is not None:
                made = encode(values)
                f.write(made)
                lengths.append(len(made))
                if last:
                    f.close()
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([name]), pa.array([lengths], pa.list_(pa.int64()))], ["block", "path", "lengths"])

        for batch in batches:
            stretch, at, value, of = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.flatnonzero((stretch[1:] != stretch[:-1]) | (of[1:] != of[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(stretch)]):
                if a == b:
                    continue
                key = int(of[a]), int(stretch[a])
                if key != now:
                    yield from ended(key[0] != now[0])
                    if key[0] != now[0]:
                        name, lengths = f"block-{key[0]:06d}-{uuid.uuid4().hex}", []
                        f = store.open_output_stream(f"{place(where)[1]}/{name}", compression=None)
                    now, values = key, np.full(width, np.nan)
                real = at[a:b] >= 0
                values[at[a:b][real]] = np.asarray(value[a:b][real], np.float64)
        yield from ended(True)

    make_folder(folder)
    made = sorted_.mapInArrow(run, "block int, path string, lengths array<long>").orderBy("block").collect()  # a row for each block
    return [(join(folder, r["path"]), list(r["lengths"])) for r in made]


def append(target: Location, head: bytes, blocks: list[str], tail: bytes = b"") -> None:
    """One file of a head, the files ``blocks`` and a tail: written beside the target, a piece at a time, and then named as it. The blocks go."""
    store, path = place(target)
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/tmp.{uuid.uuid4().hex}.{name}" if folder else f"tmp.{uuid.uuid4().hex}.{name}"
    with store.open_output_stream(draft, compression=None) as out:
        out.write(head)
        for b in blocks:
            with store.open_input_stream(place(b)[1], compression=None) as f:
                while piece := f.read(_CHUNK):
                    out.write(piece)
        out.write(tail)
    store.move(draft, path)


def write_dense(target: Location, cells: DataFrame, stretches: int, width: int, encode: Callable[[np.ndarray], bytes], head: Callable[[list[int]], bytes], tail: Callable[[list[int]], bytes] = lambda _: b"") -> None:
    """A file of ``stretches`` (see :func:`write_blocks`), with what ``head`` and ``tail`` make of the lengths of all of them."""
    folder = f"{target}.tmp.{uuid.uuid4().hex}"
    try:
        blocks = write_blocks(cells, stretches, width, encode, folder) if stretches else []
        lengths = [n for _, own in blocks for n in own]
        append(target, head(lengths), [p for p, _ in blocks], tail(lengths))
    finally:
        remove_folder(folder)
