"""Language of web pages by Bayesian evidence fusion.

Three kinds of evidence are multiplied: the likelihood of the page's text under character trigram models of each language;
the language that the markup declares, through a smoothed table of how often pages that read as one language declare
another; and a prior of the host, which leans on the prior of its address suffix, which leans on that of all pages.  The
priors count declared languages of all other pages (a page does not speak for itself) by grouped aggregates.

The trigram models are counted over all documents that have a language; trigrams are hashed to ``2 ** SLOT_BITS`` slots, so
the model has one fixed-size column a language.  Host and suffix counts are joined, never collected.

A page without text has no text evidence, one without a declaration none of that, one without a usable address only the
prior of all pages; with no evidence at all languages are as likely as documents have them.  Without documents the language
is NULL.  Repeated rows get equal results.  Columns besides the named ones are not read.

Comments, scripts, styles, navigation and heads are cut out where they end; openings that never end are tags like others.
A page is read in time that grows with its length only, whatever it opens and leaves open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.tables import BLANKS, arrow_map, documents, written
from hashmark.llm.textbytes import LOWER, SPACE, chunks, flat, mix

SLOT_BITS = 16
#: Weight of a text's trigrams against the other evidence: neighbouring trigrams are far from independent.
TEXT_WEIGHT = 0.1
#: Pages that the next wider prior counts as, and pages that a declaration table starts with in each cell.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 4.0, 20.0, 1.0


def _trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of every run of three bytes of a row; A-Z are lowered and blanks are one sign."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    even = np.where(SPACE[data], np.uint8(32), LOWER[data]).astype(np.uint64)
    key = even[:-2] << np.uint64(16) | even[1:-1] << np.uint64(8) | even[2:]
    row = np.searchsorted(bounds, np.arange(len(key)), side="right") - 1
    inside = np.arange(len(key)) + 2 < bounds[row + 1]
    return (mix(key[inside]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), row[inside]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and a row of slot log-probabilities for each; the last column is the log-prior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            data, offsets = flat(batch.column(0))
            for lo, part, bounds in chunks(data, offsets):
                found, rows = _trigrams(part, bounds)
                own = langs[lo : lo + len(bounds) - 1]
                for lang in set(own):
                    mine = own == lang
                    total = counts.setdefault(lang, np.zeros((1 << SLOT_BITS) + 1, dtype=np.int64))
                    total[:-1] += np.bincount(found[mine[rows]], minlength=1 << SLOT_BITS)
                    total[-1] += mine.sum()
        for lang, total in counts.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen), pa.array(total[seen])], names=["lang", "slot", "n"])

    some = docs.filter(F.col(lang_col).isNotNull()).select(text_col, lang_col)
    counts = arrow_map(some, run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), (1 << SLOT_BITS) + 1))
    table[np.searchsorted(langs, counts["lang"]) if langs else [], counts["slot"]] = counts["n"]
    model = np.log((table[:, :-1] + 0.5) / (table[:, :-1].sum(axis=1, keepdims=True) + 0.5 * (1 << SLOT_BITS)))
    prior = np.log((table[:, -1:] + 0.5) / (table[:, -1].sum() + 0.5 * max(1, len(langs))))
    return langs, np.hstack([model, prior]).astype(np.float32)


_OPENING = re.compile(r"<!--|<(script|style|nav|head)\b", re.I | re.A)
_ENDS = {kind: re.compile(rf"</{kind}\s*>", re.I | re.A) for kind in ("script", "style", "nav", "head")} | {"": re.compile("-->")}
_TAG_OR_SIGN, _SIGN = re.compile(r"<[^>]*>|&[#\w]+;", re.A), re.compile(r"&[#\w]+;", re.A)


def visible(html: str) -> str:
    """What a page shows, without tags and character references."""
    kept, at, done, endless = [], 0, 0, set()
    while opening := _OPENING.search(html, at):
        kind, at = (opening[1] or "").lower(), opening.end()
        end = None if kind in endless else _ENDS[kind].search(html, at)
        if end is None:
            endless.add(kind)  # nor will any later one of its kind end
        else:
            kept.append(html[done : opening.start()])
            at = done = end.end()
    bare = " ".join([*kept, html[done:]])
    last = bare.rfind(">") + 1  # behind it no tag ends
    return (_TAG_OR_SIGN.sub(" ", bare[:last]) + _SIGN.sub(" ", bare[last:])).strip(BLANKS)


def evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``host``, ``suffix``, ``declared`` and ``text`` (visible text) of each page; what is missing is NULL."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    suffix = F.regexp_extract("host", r"\.([a-z]+)$", 1)
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1))
    rows = pages.select("page_id", F.nullif(host, F.lit("")).alias("host"), F.nullif(declared, F.lit("")).alias("declared"), html.alias("html"))
    rows = rows.withColumn("suffix", F.nullif(suffix, F.lit(""))).select("page_id", "host", "declared", "suffix", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([visible(h) for h in batch.column(4).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], text], names=["page_id", "host", "declared", "suffix", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(rows, run, f"page_id {kind}, host string, declared string, suffix string, text string")


def with_likelihoods(found: DataFrame, model: np.ndarray) -> DataFrame:
    """``found`` without the text, with ``likelihoods``: a weighted log-likelihood for each language, 0 for all without text."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in found.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, part, bounds in chunks(data, offsets):
                slots, rows = _trigrams(part, bounds)
                n = len(bounds) - 1
                sums = np.stack([TEXT_WEIGHT * np.bincount(rows, own[slots], minlength=n) for own in table], axis=1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.reshape(-1)), len(table)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, n) for c in keep), lists], names=[*keep, "likelihoods"])

    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(found.select(*keep, "text"), run, f"{kinds}, likelihoods array<double>")


def languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``declared``, ``text_lang`` (by text alone), ``lang`` and ``confidence`` of every page."""
    langs, model = fit(docs)
    found = evidence(pages)
    if not langs:
        return found.select("page_id", "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    names = F.array(*map(F.lit, langs))
    best = F.when(F.array_max("likelihoods") < 0, names[F.array_position("likelihoods", F.array_max("likelihoods")).cast("int") - 1])
    read = written(with_likelihoods(found, model[:, :-1]).withColumn("text_lang", best), "language-evidence")
    told = read.filter(F.col("declared").isin(langs))

    def votes(*by: str) -> DataFrame:
        counts = F.array(*(F.count_if(F.col("declared") == lang).cast("double") for lang in langs))
        return told.groupBy(*by).agg(counts.alias("n_" + "_".join(by) if by else "n_all"))

    # how often pages that read as one language declare each: (declared, as many numbers as languages)
    reads = F.array(*(F.count_if(F.col("text_lang") == lang).cast("double") for lang in langs))
    table = {r["declared"]: r["n"] for r in told.filter("text_lang IS NOT NULL").groupBy("declared").agg(reads.alias("n")).collect()}
    cells = np.array([table.get(lang, [0.0] * len(langs)) for lang in langs]) + DECLARED_WEIGHT
    declared = np.log(cells / cells.sum(axis=0))
    whole = votes().first()
    all_votes = F.array(*(F.lit(float(v)) for v in whole["n_all"]))
    start = np.exp(model[:, -1].astype(float))
    joined = read.join(votes("suffix"), "suffix", "left").join(votes("host"), "host", "left")
    posts, total = [], []
    for k, lang in enumerate(langs):
        own = F.when(F.col("declared") == lang, 1.0).otherwise(0.0)
        spoke = F.when(F.col("declared").isin(langs), 1.0).otherwise(0.0)

        def narrowed(counts, weight: float, wider, k=k, own=own, spoke=spoke):
            """The prior of ``counts`` without this page's own vote, leaning on the wider one."""
            n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
            return F.when(counts.isNull(), wider).otherwise((counts[k] - own + weight * wider) / (n - spoke + weight))

        prior = narrowed(all_votes, SUFFIX_WEIGHT, F.lit(float(start[k])))
        prior = narrowed(F.col("n_suffix"), SUFFIX_WEIGHT, prior)
        prior = narrowed(F.col("n_host"), HOST_WEIGHT, prior)
        tag = F.lit(0.0)
        for j, other in enumerate(langs):
            tag = F.when(F.col("declared") == other, float(declared[j][k])).otherwise(tag)
        posts.append((F.col("likelihoods")[k] + F.log(prior) + tag).alias(f"p{k}"))
        total.append(F.exp(F.col("post")[k] - F.array_max("post")))
    fused = joined.select("page_id", "host", "declared", "text_lang", F.array(*posts).alias("post"))
    return fused.select(
        "page_id", "host", "declared", "text_lang",
        names[F.array_position("post", F.array_max("post")).cast("int") - 1].alias("lang"), (1 / sum(total)).alias("confidence"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))
