"""Best-fit packing of token sequences with certified bin counts.

Texts are tokenized once; only their pieces (ids and lengths, never tokens) move afterwards.  Pieces are dealt into
groups of bounded size and packed best-fit decreasing.  Dual feasible functions give each group a lower bound: a group
that meets it is certified optimal.  Groups with a gap release the pieces of their unfilled sequences, certified groups
those of their emptiest one; what is released is dealt anew, packed again and kept where that takes fewer sequences.

NULL and empty texts are one end-of-text id long.  Repeated rows are packed as often as they occur.  Nothing is dropped:
every piece is in exactly one sequence.  Columns besides the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashmark.llm.bpe import codec, read_vocabulary, vocabulary_path
from hashmark.llm.tables import arrow_map, documents, ship, written

CAPACITY = 2048
END_ID = 0
#: Pieces in a group, on average: what one task holds at a time.
GROUP_ROWS = 50_000
ROUNDS = 4


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``piece``, ``start``, ``length`` and ``ids_crc32`` of each row's pieces.

    The ids of a text end with ``end_id``.  Up to ``capacity`` ids are one piece; longer ones are cut into pieces of
    ``capacity``, of which the first may be shorter.
    """
    blob = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value)
        for batch in batches:
            done = 0
            for ids, ends in own.encode(batch.column(1)):
                raw, at, rows = ids.astype("<u4").tobytes(), 0, []
                for k, stop in enumerate(ends.tolist()):
                    text, at = raw[4 * at : 4 * stop] + end, stop
                    total = len(text) // 4
                    start, number = 0, 0
                    while start < total:
                        length = (total - start - 1) % capacity + 1 if number == 0 else capacity
                        rows.append((done + k, number, start, length, zlib.crc32(text[4 * start : 4 * (start + length)])))
                        start, number = start + length, number + 1
                done += len(ends)
                columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0])), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    schema = T.StructType([
        docs.schema[id_col], T.StructField("piece", T.IntegerType()),
        *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")),
    ])
    return arrow_map(docs.select(id_col, text_col), run, schema)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound on the number of bins that two families of dual feasible functions prove."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    tokens = counts * sizes
    best = -(-int(tokens.sum()) // capacity)
    # small sizes count nothing, sizes over capacity - k a whole bin
    number, volume = np.cumsum(counts), np.cumsum(tokens)
    for k in range(1, capacity // 2 + 1):
        large = number[-1] - number[capacity - k]
        middle = volume[capacity - k] - volume[k - 1]
        best = max(best, int(large) + -(-int(middle) // capacity))
    # sizes rounded to multiples of 1 / k of a bin, unless they are multiples of 1 / (k + 1)
    for k in range(1, 101):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each length, longest first into the fullest bin that takes it, and the room left in each bin."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = open_rooms >> length
        if fitting:
            r = (fitting & -fitting).bit_length() - 1 + length
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - length
        if r > length:
            by_room[r - length].append(b)
            open_rooms |= 1 << (r - length)
    return bins, offsets, np.array(room, dtype=np.int64)


def _pack(rows: DataFrame, n_groups: int, round_number: int, capacity: int) -> DataFrame:
    """Pieces with ``sequence_id``, ``offset`` and ``released``: whether the next round may deal them again."""
    ship(rows.sparkSession)
    own = [c for c in rows.columns if c not in ("sequence_id", "offset", "released")]
    dealt = rows.select(*own).withColumn("group", F.pmod(F.xxhash64(F.lit(round_number), *own), F.lit(n_groups)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), *((c, "descending") for c in own if c != "length")])
        lengths = group.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) > lower_bound(lengths, capacity)
        free = room > 0 if gap else (np.arange(len(room)) == int(np.argmax(room))) & (room > 0)
        number = (round_number << 56) + (group.column("group")[0].as_py() << 24)
        return (
            group.drop_columns(["group"]).append_column("sequence_id", pa.array(number + bins))
            .append_column("offset", pa.array(offsets)).append_column("released", pa.array(free[bins]))
        )

    schema = T.StructType([
        *(rows.schema[c] for c in own), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("released", T.BooleanType()),
    ])
    return dealt.groupBy("group").applyInArrow(run, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``cut`` has a ``length`` of 1 to ``capacity``, null elsewhere."""
    done = None
    rows = cut
    count = rows.count()
    before = None
    for number in range(rounds):
        packed = written(_pack(rows, max(1, -(-count // group_rows)), number, capacity), f"packed-{number}")
        after = packed.agg(F.countDistinct("sequence_id").alias("n")).first()["n"]
        if before is not None and after >= before[0]:
            return done.unionByName(before[1].drop("released"))
        closed = packed.filter(~F.col("released")).drop("released")
        done = closed if done is None else done.unionByName(closed)
        rows = packed.filter("released")
        row = rows.agg(F.count("*").alias("rows"), F.countDistinct("sequence_id").alias("n")).first()
        count, before = row["rows"], (row["n"], rows)
        if row["n"] < 2:
            break
    return done.unionByName(rows.drop("released"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = written(pieces(documents(spark, sf_dir), vocabulary_path()), "pieces")
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
