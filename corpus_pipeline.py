"""From raw documents to encoded training text, as stages that are written and read again.

A stage gives its operator the id, the source and the text, and all other columns as one, so that no column of the
caller's can clash with one that the operator makes: whatever their names are, they come out as they went in, but for
``text`` and, where the table has it, ``n_chars``, which the stages that cut texts set anew. Null texts count as empty,
rows that repeat stay rows of their own until a stage drops copies, and a table without rows passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.llm import bpe, mixing, simhash, toxicity, windows
from snapforge.llm.common import fold, quoted
from snapforge.llm.queries import tokenizer_path
from snapforge.session import scratch_path

_ROW = "caller"
MIX_BLOCK = 128  # words


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """``text``, the columns ``names`` that the operator looks at, and all columns but the text as one."""
    rest = [quoted(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias(_ROW), *map(quoted, names), quoted("text"))


def _unpacked(df: DataFrame, docs: DataFrame, text: Column, cut: Column | None = None) -> DataFrame:
    """The columns of ``docs``, with ``text``, and with its length in ``n_chars`` where ``cut`` is true."""

    def column(name: str) -> Column:
        own = F.col(_ROW).getField(name)
        if name == "text":
            return text
        if name == "n_chars" and cut is not None:
            return F.when(cut, F.length(text)).otherwise(own).cast(docs.schema[name].dataType)
        return own

    return df.select(*[column(c).alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not called toxic; the model learns from labelled documents outside the held-out part.

    A null or empty text has no toxic sign and stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = labels.filter(~fold(F.col("doc_id"), 4, 2))
    scored = toxicity.score(_packed(docs), toxicity.fit(docs.select("doc_id", "text"), learn))
    return _unpacked(scored.filter("predicted = 0"), docs, F.col("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (null last).

    All texts without a word are copies of each other. Of rows that share the smallest id one stays, and a run keeps to
    its choice.
    """
    return _unpacked(simhash.keep_first(_packed(docs, "doc_id")), docs, F.col("text"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one; texts that lose nothing stay as they are, also null ones."""
    cut = windows.remove_repeats(_packed(docs, "doc_id"))
    lost = F.col("n_removed") > 0
    return _unpacked(cut, docs, F.when(lost, F.col("kept_text")).otherwise(F.col("text")), lost)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of one that is not taken in whole the words of its picked blocks stay.

    Blocks are long enough that most documents stay in one piece.

    Documents without a word go, since nothing of them can be taken. A null source is a source of its own.
    """
    return _unpacked(mixing.mixed_documents(_packed(docs, "doc_id", "source"), block=MIX_BLOCK), docs, F.col("text"), F.lit(True))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the digests of the ids and of the decoded text; a null text has no ids."""
    return bpe.encode_digests(docs.select("doc_id", "source", "text"), tokenizer_path()).drop("text")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

# A fitted classifier and a tokenizer are part of the stages, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
