"""A tensor laid out for many updates of one factor: compressed fibres in blocks, to which factor rows are sent.

A fibre holds the cells of one index of the mode to be updated and one of the next mode, as sorted arrays of the
third index and the values. The sum over a fibre takes one multiplication by the next mode's factor row, not one for each cell.
Fibres lie in blocks by the index to be updated and stay there; which block needs which factor row is found out once.
So an update moves factor rows, each at most once to a block, and the sums per index; no cell is shuffled again.

Indexes with more cells than a block on average are spread over all blocks, and fibres are cut every
``FIBRE_SPAN`` indexes, so neither a hot index nor a hot pair fills a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectral_topics.functions.batches import one_thread
from spectral_topics.functions.columns import matrix_columns, named
from spectral_topics.functions.skew import MIN_HOT_ROWS, hot_keys

MODES = ("i", "j", "l")
# Cells in a block. A task holds them, and at most two factor rows for each.
BLOCK_CELLS = 1_000_000
# Width of a fibre in indexes of its third mode.
FIBRE_SPAN = 1 << 16
# Numbers multiplied at once.
PIECE_CELLS = 1 << 20


class Fibres:
    """Cells ``(i, j, l, val)``, each index triple once, laid out for updates of ``mode``. Call ``close`` after the last."""

    def __init__(self, cells: DataFrame, mode: int, min_hot_rows: int | None = None, block_cells: int = BLOCK_CELLS):
        self.mode, self.others = mode, [m for m in range(3) if m != mode]
        own, (a, b) = MODES[mode], (MODES[m] for m in self.others)
        least = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total, hot = hot_keys(
            cells,
            own,
            lambda rows: max(min(MIN_HOT_ROWS, block_cells) if min_hot_rows is None else min_hot_rows, rows // max(least, -(-rows // block_cells))),
        )
        self.blocks = max(least, -(-total // block_cells))
        rows = cells.select(F.col(own).alias("idx"), F.col(a).alias("a"), F.col(b).alias("b"), "val")
        rows = rows.withColumn("span", F.floor(F.col("b") / FIBRE_SPAN))
        place = F.xxhash64("idx")
        if hot is not None:
            rows = rows.join(F.broadcast(hot.toDF("idx").withColumn("spread", F.lit(True))), "idx", "left")
            place = F.when(F.col("spread"), F.xxhash64("idx", "a", "span")).otherwise(place)
        rows = rows.withColumn("block", F.pmod(place, F.lit(self.blocks)).cast("int")).repartitionById(self.blocks, "block")
        ordered = F.array_sort(F.collect_list(F.struct("b", "val")))
        packed = rows.groupBy("block", "idx", "a", "span").agg(ordered.alias("cells"))
        packed = packed.select("block", "idx", "a", F.col("cells.b").alias("b"), F.col("cells.val").alias("val"))
        self.table = packed.sortWithinPartitions("block", "idx", "a").persist(StorageLevel.MEMORY_AND_DISK)
        self.routes = [self._route(self.table.select("block", "a")), self._route(self.table.select("block", F.explode("b").alias("b")))]

    @staticmethod
    def _route(used: DataFrame) -> DataFrame:
        """``(idx, blocks)``: the blocks that need each factor row."""
        block, index = used.columns
        pairs = used.distinct().groupBy(F.col(index).alias("idx")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
        return pairs.persist(StorageLevel.MEMORY_AND_DISK)

    def mttkrp(self, factors: Sequence[DataFrame | None]) -> DataFrame:
        """``(idx, f0, ...)``: sum over the other two modes of val * factor * factor. A cell without a factor row fails the job."""
        cols = matrix_columns(factors[self.others[0]], "f")
        sides = []
        for side, (route, other) in enumerate(zip(self.routes, self.others)):
            rows = factors[other].select("idx", F.array(*cols).alias("vec"))
            sent = route.join(rows, "idx").select(F.explode("blocks").alias("block"), F.lit(side).alias("side"), F.col("idx").cast("long").alias("idx"), "vec")
            sides.append(sent)
        sent = sides[0].unionByName(sides[1]).repartitionById(self.blocks, "block")
        rank, piece, names = len(cols), PIECE_CELLS, [MODES[m] for m in self.others]

        def add(fibres: pa.Table, rows: pa.Table) -> pa.Table:
            return _block_sums(fibres, rows, rank, piece, names)

        columns = named("f", rank)
        schema = "idx long, " + ", ".join(f"{c} double" for c in columns)
        one_thread(sent)
        partial = self.table.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(add, schema)
        # An index lies in one block unless it is spread: this adds up rows of sums, not cells.
        index = F.col("idx").cast(self.table.schema["idx"].dataType).alias("idx")
        return partial.groupBy(index).agg(*[F.sum(c).alias(c) for c in columns])

    def close(self) -> None:
        for table in (self.table, *self.routes):
            table.unpersist()


def merged_cells(tensor: DataFrame) -> DataFrame:
    """Each index triple once, repeated cells added up."""
    return tensor.groupBy(*MODES).agg(F.sum("val").alias("val"))


def _factor_rows(rows: pa.Table, side: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and values of the factor rows sent for one of the other modes."""
    kept = rows.filter(pc.equal(rows["side"], side)).combine_chunks()
    ids = kept["idx"].to_numpy()
    values = np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in kept["vec"].chunks]]).reshape(len(ids), rank)
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def _places(wanted: np.ndarray, ids: np.ndarray, name: str) -> np.ndarray:
    at = np.searchsorted(ids, wanted)
    lost = np.ones(len(wanted), bool) if not len(ids) else ids[np.minimum(at, len(ids) - 1)] != wanted
    if lost.any():
        raise ValueError(f"no factor row for {name} = {wanted[lost][0]}")
    return at


def _block_sums(fibres: pa.Table, rows: pa.Table, rank: int, piece: int, names: Sequence[str]) -> pa.Table:
    """The sums of a block, one row for each index; fibres are sorted by index."""
    (a_ids, a_rows), (b_ids, b_rows) = (_factor_rows(rows, side, rank) for side in (0, 1))
    ids, sums = [], []
    for batch in fibres.to_batches():
        if not batch.num_rows:
            continue
        sizes = pc.list_value_length(batch["b"]).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        # As many fibres at once as have about ``piece`` numbers.
        cuts = np.unique(np.append(0, np.searchsorted(ends, np.arange(max(1, piece // rank), ends[-1], max(1, piece // rank)))))
        for first, last in zip(cuts, np.append(cuts[1:], batch.num_rows)):
            part = batch.slice(first, last - first)
            if not part.num_rows:
                continue
            values = pc.fill_null(part["val"].flatten(), 0.0).to_numpy(zero_copy_only=False)
            starts = np.append(0, np.cumsum(sizes[first:last], dtype=np.int64)[:-1])
            along = b_rows[_places(part["b"].flatten().to_numpy(), b_ids, names[1])] * values[:, None]
            inner = np.add.reduceat(along, starts, axis=0) * a_rows[_places(part["a"].to_numpy(), a_ids, names[0])]
            index = part["idx"].to_numpy()
            heads = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
            ids.append(index[heads].astype(np.int64))
            sums.append(np.add.reduceat(inner, heads, axis=0))
    found = np.concatenate(sums) if sums else np.zeros((0, rank))
    columns = {"idx": np.concatenate(ids) if ids else np.zeros(0, np.int64)}
    return pa.table(columns | {f"f{r}": np.ascontiguousarray(found[:, r]) for r in range(rank)})
