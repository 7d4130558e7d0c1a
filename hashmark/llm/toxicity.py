"""Toxicity by class-conditional Kneser-Ney models of the characters in words.

Two models, toxic and ordinary, give each character of a word given the four before it.  Both discount their own counts and
back off to one shared distribution, made of continuation counts over both classes, so a rare expression is judged by its
shorter parts and an expression that neither class has seen counts for neither.  A text is compared by length-normalised
log-likelihoods: over the whole text, and over its most toxic passages of one and of ``PASSAGE`` words.  A logistic curve
over these three, fitted on rows that gave no counts, makes the score.

The models are fitted on at most ``SAMPLE_ROWS`` labelled rows of either class, those with the smallest hashes of their id;
contexts are hashed to ``2 ** CONTEXT_BITS`` slots, so what is collected and broadcast has a fixed size bound.

NULL and empty texts, and tables without labels of both classes, score by the intercept alone.  Repeated rows get equal
scores; of several labels of one id the largest counts.  Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.tables import arrow_map, documents, labels, written
from hashmark.llm.textbytes import chunks, flat, hashes, mix, words

SAMPLE_ROWS = 8_000
CONTEXT = 4
CONTEXT_BITS = 17
SIGN_BITS = 6
DISCOUNT = 0.75
PASSAGE = 6
CACHE_WORDS = 400_000
EDGE = 27


def _signs(word: str) -> list[int]:
    """Characters as 6-bit signs: letters a-z, one sign for digits, one for the edge, the rest shared among 36."""
    out = []
    for c in word.lower():
        if "a" <= c <= "z":
            out.append(ord(c) - 97)
        elif c.isdigit():
            out.append(26)
        elif c.isalpha():
            out.append(28 + ord(c) * 7 % 36)
    return out


def ngrams(spellings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of each word and for its end: the last ``CONTEXT`` signs as an integer, the sign, the word's number."""
    contexts, signs, owners = [], [], []
    mask = (1 << SIGN_BITS * CONTEXT) - 1
    edge = sum(EDGE << SIGN_BITS * k for k in range(CONTEXT))
    for k, word in enumerate(spellings):
        own = _signs(word)
        if own:
            context = edge
            for sign in [*own, EDGE]:
                contexts.append(context)
                context = (context << SIGN_BITS | sign) & mask
            signs += [*own, EDGE]
            owners += [k] * (len(own) + 1)
    return np.array(contexts, dtype=np.int64), np.array(signs, dtype=np.int64), np.array(owners, dtype=np.int64)


def slot(context: np.ndarray) -> np.ndarray:
    return (mix(context.astype(np.uint64)) >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Toxic minus ordinary log-probability of each seen (context slot, sign), in the order of its number, and weights."""

    keys: np.ndarray
    ratios: np.ndarray
    weights: tuple[float, float, float, float]


def fit_ratios(counts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From rows ``slot``, ``sign``, ``context``, ``toxic``, ``ordinary``: the keys and ratios of a model."""
    rows = counts.sort_values(["slot", "sign"], ignore_index=True)
    context = rows.groupby("slot")["context"].transform("min").to_numpy()
    sign = rows["sign"].to_numpy()
    shared = np.full(len(rows), 1.0 / (1 << SIGN_BITS))
    for order in range(CONTEXT):
        kinds = pd.DataFrame({"short": context & ((1 << SIGN_BITS * order) - 1), "longer": context & ((1 << SIGN_BITS * (order + 1)) - 1), "sign": sign})
        ways = kinds.drop_duplicates().groupby(["short", "sign"], as_index=False).size()
        ways["n"] = ways.groupby("short")["size"].transform("sum")
        ways["types"] = ways.groupby("short")["size"].transform("count")
        own = kinds[["short", "sign"]].merge(ways, on=["short", "sign"], how="left")
        shared = ((own["size"] - DISCOUNT) / own["n"]).to_numpy() + (DISCOUNT * own["types"] / own["n"]).to_numpy() * shared
    log_p = {}
    for kind in ("toxic", "ordinary"):
        c = rows[kind].to_numpy(dtype=float)
        n = rows.groupby("slot")[kind].transform("sum").to_numpy(dtype=float)
        types = (rows[kind] > 0).groupby(rows["slot"]).transform("sum").to_numpy(dtype=float)
        own = np.divide(np.maximum(c - DISCOUNT, 0), n, out=np.zeros_like(c), where=n > 0)
        rest = np.divide(DISCOUNT * types, n, out=np.ones_like(c), where=n > 0)
        log_p[kind] = np.log(own + rest * shared)
    keys = (rows["slot"].to_numpy() << SIGN_BITS | sign).astype(np.int32)
    return keys, (log_p["toxic"] - log_p["ordinary"]).astype(np.float32)


class Scorer:
    """Length-normalised log-likelihood ratios of texts, with a cache of words in the worker."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.sums, self.sizes = np.zeros(0), np.zeros(0)

    def _learn(self, fresh: dict[int, bytes]) -> None:
        context, sign, owner = ngrams([w.decode("utf-8", "replace") for w in fresh.values()])
        keys = slot(context) << SIGN_BITS | sign
        at = np.minimum(np.searchsorted(self.model.keys, keys), max(0, len(self.model.keys) - 1))
        values = np.where(self.model.keys[at] == keys, self.model.ratios[at], 0.0) if len(self.model.keys) else np.zeros(len(keys))
        self.known.update(zip(fresh, range(len(self.sums), len(self.sums) + len(fresh)), strict=True))
        self.sums = np.concatenate([self.sums, np.bincount(owner, values, minlength=len(fresh))])
        self.sizes = np.concatenate([self.sizes, np.maximum(1, np.bincount(owner, minlength=len(fresh)))])

    def features(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For consecutive rows: ratio of the whole text, of its most toxic word and passage, each per character."""
        data, offsets = flat(column)
        for _, part, bounds in chunks(data, offsets):
            starts, lengths, rows = words(part, bounds)
            values, first, inverse = np.unique(hashes(part, starts, lengths), return_index=True, return_inverse=True)
            raw, known = part.tobytes(), self.known
            self._learn({
                v: raw[a : a + n] for v, a, n in zip(values.tolist(), starts[first].tolist(), lengths[first].tolist(), strict=True) if v not in known
            })
            place = np.array([known[v] for v in values.tolist()], dtype=np.int64)[inverse]
            sums, sizes = self.sums[place], self.sizes[place]
            edges = np.searchsorted(rows, np.arange(len(bounds)))
            yield _features(sums, sizes, rows, edges)
            if len(known) > CACHE_WORDS:
                self.forget()


def _features(sums: np.ndarray, sizes: np.ndarray, rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros((len(edges) - 1, 3))
    some = np.flatnonzero(np.diff(edges) > 0)
    if not len(some):
        return out
    total, length = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(sizes)])
    out[some, 0] = (total[edges[1:]] - total[edges[:-1]])[some] / (length[edges[1:]] - length[edges[:-1]])[some]
    out[some, 1] = np.maximum.reduceat(sums / sizes, edges[:-1][some])
    # a passage ends with its text: near the end it is shorter
    begin = np.arange(len(sums))
    end = np.minimum(begin + PASSAGE, edges[rows + 1])
    begin = np.maximum(np.minimum(begin, end - PASSAGE), edges[rows])
    out[some, 2] = np.maximum.reduceat((total[end] - total[begin]) / (length[end] - length[begin]), edges[:-1][some])
    return out


def fit_weights(features: np.ndarray, toxic: np.ndarray, ridge: float = 0.01, steps: int = 30) -> tuple[float, float, float, float]:
    """Intercept and weights of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.1, 1.0, 1.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + penalty @ w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
    return tuple(float(v) for v in w)


def _sampled(labelled: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """``id``, ``toxic`` of at most ``rows`` rows of either class, those with the least hashes."""
    one = labelled.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        (F.max(label_col) > 0).alias("toxic")
    )
    kinds = [one.filter(k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (F.col("toxic"), ~F.col("toxic"))]
    return kinds[0].unionByName(kinds[1])


def _counted(sample: DataFrame) -> DataFrame:
    """``slot``, ``sign``, ``context`` and the numbers of texts, by class, whose distinct words have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = flat(batch.column(0))
            for row, part, bounds in chunks(data, offsets):
                starts, lengths, rows = words(part, bounds)
                values, first, inverse = np.unique(hashes(part, starts, lengths), return_index=True, return_inverse=True)
                once = np.unique(rows * max(1, len(values)) + inverse)
                kind, word = toxic[row + once // max(1, len(values))], once % max(1, len(values))
                raw = part.tobytes()
                spelled = [raw[a : a + n].decode("utf-8", "replace") for a, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
                context, sign, owner = ngrams(spelled)
                counts = [np.bincount(word[kind == k], minlength=len(values))[owner] for k in (True, False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (slot(context), sign, context, *counts)], names=["slot", "sign", "context", "toxic", "ordinary"]
                )

    rows = arrow_map(sample.select("text", "toxic"), run, "slot long, sign long, context long, toxic long, ordinary long")
    return rows.groupBy("slot", "sign").agg(F.min("context").alias("context"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _with_features(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the three ratios of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            lo = 0
            for found in scorer.features(batch.column("text")):
                own = [batch.column(c).slice(lo, len(found)) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(found[:, k]) for k in range(3))], names=[*keep, "overall", "worst_word", "worst_passage"])
                lo += len(found)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(docs.select(*keep, "text"), run, f"{kinds}, overall double, worst_word double, worst_passage double")


def fit(docs: DataFrame, labelled: DataFrame, label_col: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a bounded sample of labelled rows: two thirds of it are counted, one third sets the weights."""
    sample = _sampled(labelled, id_col, label_col, rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = written(texts.join(F.broadcast(sample), "id"), "toxicity-sample")  # at most 2 * rows ids
    third = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(3)) == 0
    counts = _counted(sample.filter(~third)).toPandas()
    keys, ratios = fit_ratios(counts) if len(counts) else (np.zeros(0, np.int32), np.zeros(0, np.float32))
    rest = _with_features(sample.filter(third), Model(keys, ratios, (0.0,) * 4), ["toxic"]).toPandas()
    toxic = rest["toxic"].to_numpy(dtype=float)
    if 0 < toxic.sum() < len(toxic):
        weights = fit_weights(rest[["overall", "worst_word", "worst_passage"]].to_numpy(), toxic)
    else:
        share = (toxic.sum() + 0.5) / (len(toxic) + 1)
        weights = (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0)
    return Model(keys, ratios, weights)


def score_column(model: Model) -> Column:
    w = [F.lit(x) for x in model.weights]
    return 1 / (1 + F.exp(-(w[0] + w[1] * F.col("overall") + w[2] * F.col("worst_word") + w[3] * F.col("worst_passage"))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the three ratios and ``score`` (0 to 1) of every row."""
    texts = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _with_features(texts, model, [id_col]).withColumn("score", score_column(model))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, labels(spark, sf_dir).filter(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "overall", "worst_word", "worst_passage"
    )
