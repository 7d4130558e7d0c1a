"""A corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, suffix-array dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes it as Parquet in the shared folder and gives
the next stage what it reads back, so a lost executor costs one stage at most.  All but the last stage return the columns
of ``documents`` and no others.  Every row gets its own decision, also where ids are NULL or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashmark.llm.bpe import vocabulary_path
from hashmark.llm.lines import dedup_lines
from hashmark.llm.minhash import near_duplicates
from hashmark.llm.packing import pack, pieces
from hashmark.llm.quality import quality_rules
from hashmark.llm.suffix import remove_repeats
from hashmark.llm.tables import documents, labels, written

BESIDE = ("lang", "source")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BESIDE_ID = COLUMNS[1:]


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the number of characters of the new text."""
    return rows.select("doc_id", "text", "others.*").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject."""
    kept = quality_rules(docs, labels(spark, sf_dir), others=BESIDE_ID).filter("kept")
    return kept.select("doc_id", "others.*").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are like an earlier line; documents of which no line is left go."""
    done = dedup_lines(docs, others=BESIDE)
    return _documents(done.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: shingles of five words, a similarity of 0.8.  Rows without an id stay."""
    kept = near_duplicates(docs, others=BESIDE_ID).filter("first")
    return kept.select("doc_id", "others.*").select(*COLUMNS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that occur anywhere else; documents of which nothing is left go.

    Of a character that is cut in two nothing stays.
    """
    done = remove_repeats(docs, others=BESIDE).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    broken = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\uFFFD", "")
    text = F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")).otherwise(broken)
    return _documents(done.withColumn("text", text))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of 2048 tokens."""
    return pack(written(pieces(docs, vocabulary_path()), "pieces"))


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", keep_one_of_each_group),
    ("suffix-array dedup", drop_repeated_strings),
    ("packing", pack_sequences),
]

#: Learned rules and packing are not SQL; ``tests/llm`` compares the operators with plain versions and checks what the stages
#: must keep true of each other's rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
