"""Exact nearest neighbours by cosine: a block matrix join with quantised tiles.

Equal vectors are one class, of which only the ``k + 1`` smallest ids can be among anyone's ``k`` nearest.  Query classes and
candidate classes are dealt into blocks of bounded bytes; every pair of blocks meets in one group of a task, so both sides are
copied once for each block of the other and nothing is sent whole to anyone.  Inside a group:

* unit vectors are held as int8 with one scale each, and products of int8 tiles give every pair's cosine up to a bound that
  follows from the lengths of what was rounded off (Cauchy-Schwarz), proven for every pair;
* pairs whose upper bound reaches the ``k + 1``-th best lower bound (or found cosine) of their query survive and are computed
  in double precision from the original vectors, term by term in order, so that equal vectors always score the same;
* a bounded heap for each query takes what the tiles bring; heaps of the groups are merged by a grouped limit.

No pair is left out unseen, so recall is 1.  The work is queries times candidates, as the query set asks for; memory is not.

NULL, empty and zero vectors, those with a NULL, NaN or infinite component, and rows without an id take no part.  Vectors are
compared with vectors of their own length only.  Repeated ids and rows are candidates and queries of their own: a query leaves
out one row with its id and vector.  Ties go to the smaller id.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashmark.llm.hot import join_groups
from hashmark.llm.tables import ship, written

#: Bytes of vectors (in doubles) in one side of a group, on average.
BLOCK_BYTES = 16 << 20
#: A group is not made smaller than this to keep all cores busy.
LEAST_ROWS = 512
QUERY_TILE, TILE = 256, 4096
#: Products of int8 are summed in float32, exactly up to 2^24: this many components at a time.
EXACT_COMPONENTS = 1024
#: Above every rounding of the tiles' scaling in float32.
SLACK = 1e-5
PAIRS = 20_000


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the ``k`` nearest other rows of every row that ``is_query`` (of its id)."""
    rows = _valid(vectors, vec_id, embedding)
    classes = written(_classes(rows.withColumn("q", F.coalesce(is_query(F.col("id")), F.lit(False))), k), "vector-classes")
    spark = vectors.sparkSession
    size = classes.agg(F.count("*").alias("n"), F.count_if("q").alias("nq"), F.max(F.size("v")).alias("width")).first()
    if not size["nq"]:
        return classes.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    most = max(LEAST_ROWS, block_bytes // (8 * size["width"]))
    cores = spark.sparkContext.defaultParallelism
    n_query = -(-size["nq"] // most)
    n_cand = max(-(-size["n"] // most), min(-(-size["n"] // LEAST_ROWS), -(-2 * cores // n_query)))
    found = written(_blocks(classes, n_query, n_cand, k), "vector-heaps")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    near = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score", "own"))).alias("near"))
    asked = rows.filter(is_query(F.col("id"))).select("id", "v")
    results = written(classes.filter("q").select(F.col("class").alias("query"), "v", "n_asked").join(near, "query").drop("query"), "vector-results")
    met = join_groups(asked, results, ["v"], "n_asked")
    own = F.array_position(F.transform("near", lambda x: x["own"] & (x["id"] == F.col("id"))), F.lit(True))
    kept = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("self")), 1, k)
    return (
        met.filter("near IS NOT NULL").withColumn("self", own).select(F.col("id").alias("query_id"), F.posexplode(kept))
        .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("vec_id"), "col.score")
    )


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.transform(embedding, lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors with their smallest ids; both windows are limited in each task before rows are shuffled."""
    least = Window.partitionBy("v", "q").orderBy("id")
    first = rows.withColumn("at", F.row_number().over(least)).filter(F.col("at") <= k + 1)
    asked = rows.filter("q").groupBy("v").agg(F.count("*").alias("n_asked"))
    ids = first.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("q").alias("q"))
    return ids.join(asked, "v", "left").select(F.monotonically_increasing_id().alias("class"), "v", "ids", "q", "n_asked")


def _blocks(classes: DataFrame, n_query: int, n_cand: int, k: int) -> DataFrame:
    ship(classes.sparkSession)
    width = F.size("v").alias("width")

    def dealt(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.col("class"), F.lit(seed)), F.lit(n)).cast("int")

    left = classes.filter("q").select(width, dealt(n_query, 1).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))).alias("c"), "class", "v")
    right = classes.select(width, F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("r"), dealt(n_cand, 2).alias("c"), "class", "v", "ids")
    keys = ["width", "r", "c"]

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return block_search(queries, candidates, k)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query long, id long, score double, own boolean")


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale, length of the quantised vector and length of the error, for unit vectors in rows."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((unit - back) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact products of two tiles of int8 vectors, by the floating point unit."""
    parts = range(0, a.shape[1], EXACT_COMPONENTS)
    exact = [a[:, i : i + EXACT_COMPONENTS].astype(np.float32) @ b[:, i : i + EXACT_COMPONENTS].astype(np.float32).T for i in parts]
    return exact[0] if len(exact) == 1 else np.sum([x.astype(np.float64) for x in exact], axis=0)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed component by component: the same two vectors give the same sum wherever they stand."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def block_search(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The ``k + 1`` best candidate rows for each query class of one pair of blocks."""
    names = ["query", "id", "score", "own"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
    if not queries.num_rows or not candidates.num_rows:
        return pa.Table.from_arrays([pa.array([], kind) for kind in kinds], names=names)
    x, y = _matrix(queries), _matrix(candidates)
    # a power of two scales without rounding and keeps squares from overflowing
    x, y = (m * np.exp2(-np.frexp(np.abs(m).max(axis=1))[1].astype(np.float64))[:, None] for m in (x, y))
    x_norm, y_norm = np.sqrt(in_order(x, x)), np.sqrt(in_order(y, y))
    x_codes, x_scale, _, x_error = quantised(x / x_norm[:, None])
    y_codes, y_scale, y_size, y_error = quantised(y / y_norm[:, None])
    x_class, y_class = (t.column("class").to_numpy() for t in (queries, candidates))
    ids = candidates.column("ids").combine_chunks()
    id_values, id_at = np.asarray(ids.flatten()), np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))])
    keep, out = k + 1, []
    for q in range(0, len(x), QUERY_TILE):
        rows = slice(q, min(q + QUERY_TILE, len(x)))
        heaps: list[list[tuple]] = [[] for _ in range(rows.stop - q)]
        floor = np.full(len(heaps), -np.inf)
        for c in range(0, len(y), TILE):
            cols = slice(c, min(c + TILE, len(y)))
            about = products(x_codes[rows], y_codes[cols]) * x_scale[rows, None].astype(np.float32) * y_scale[None, cols].astype(np.float32)
            bound = x_error[rows, None].astype(np.float32) * y_size[None, cols].astype(np.float32) + y_error[None, cols].astype(np.float32) + np.float32(SLACK)
            if cols.stop - c >= keep:
                lower = about - bound
                floor = np.maximum(floor, np.partition(lower, -keep, axis=1)[:, -keep])
            i, j = np.nonzero(about + bound >= floor[:, None].astype(np.float32))
            for at in range(0, len(i), PAIRS):
                a, b = i[at : at + PAIRS], j[at : at + PAIRS] + c
                score = in_order(x[a + q], y[b]) / (x_norm[a + q] * y_norm[b])
                _push(heaps, floor, a, b, score, id_values, id_at, x_class[q:], y_class, keep)
        for at, heap in enumerate(heaps):
            out += [(int(x_class[q + at]), -minus, score, own) for score, minus, own in heap]
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.Table.from_arrays([pa.array(columns[i], kind) for i, kind in zip((0, 1, 2, 3), kinds)], names=names)


def _push(heaps, floor, a, b, score, id_values, id_at, x_class, y_class, keep) -> None:
    """Put scored pairs into the heaps of their queries, of which each keeps the best rows (largest score, then smallest id)."""
    order = np.lexsort((id_values[id_at[b]], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    for r, s, v in zip(a[place < keep].tolist(), b[place < keep].tolist(), score[place < keep].tolist()):
        heap, own = heaps[r], bool(x_class[r] == y_class[s])
        for one in id_values[id_at[s] : id_at[s + 1]].tolist():
            entry = (v, -one, own)
            if len(heap) < keep:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == keep:
            floor[r] = max(floor[r], heap[0][0])


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
