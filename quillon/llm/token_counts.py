"""Token counts of documents in flat, unindexed token files.

Method: separator scan.  A token file is a flat run of little-endian ids in which an
end-of-document id closes each document; nothing records where documents lie.  The
file is held as blocks of ``block_tokens`` ids cut without regard to documents.  Each
block is searched for separators in one vectorised comparison, which yields the
positions inside the block.  A prefix scan over the blocks of a file then stitches:
the tokens behind the last separator of earlier blocks are carried to the first
separator of a later one, and the separators before a block number its documents.

Scale: the tokens are read once and never shuffled; only separator positions
(4 bytes per document) and one row per block are.  The scan runs per file, and a file
is what one writing task made, so no scan spans the corpus.

Cases: a file's tokens behind its last separator are an unclosed document, reported
with closed = false; two separators in a row are a document of 0 tokens; a null text
is written as an empty document; a file without tokens has no rows; null ids stay
null; repeated rows are documents of their own; an id that the files' type can't hold is
an error; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import bpe
from quillon.llm.common import checkpoint, delete, scratch

BLOCK_TOKENS = 1 << 19
END_ID = 50256
_FILE = pa.schema([("file", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.binary())])


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise documents into flat token files of ids of type ``dtype``, one per task; an id that it can't hold is an error.

    Rows with tokens are a file's blocks in order (file, seq); rows without tokens
    note which document was written as the seq-th, which the scan doesn't read.
    """
    vocab, greatest = vocabulary or bpe.default_vocabulary(), np.iinfo(dtype).max

    def fitting(ids: np.ndarray) -> np.ndarray:
        if len(ids) and ids.max() > greatest:
            raise ValueError(f"token id {ids.max()} is too large for {dtype}")
        return ids.astype(dtype)

    def run(batches):
        from pyspark import TaskContext

        encode, file = bpe.encoder(vocab).ids, TaskContext.get().partitionId()
        end, pending, held, blocks, written = fitting(np.array([end_id])), [], 0, 0, 0

        def rows(seqs, ids, tokens):
            return pa.RecordBatch.from_arrays([pa.array([file] * len(seqs), pa.int64()), pa.array(seqs, pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], schema=_FILE)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for text in batch.column(1):
                tokens = fitting(encode(text.as_py()))
                pending += [tokens, end]
                held += len(tokens) + 1
                if held >= block_tokens:
                    flat = np.concatenate(pending)
                    full = held // block_tokens
                    for k in range(full):
                        yield rows([blocks + k], [None], [flat[k * block_tokens : (k + 1) * block_tokens].tobytes()])
                    blocks, pending, held = blocks + full, [flat[full * block_tokens :]], held % block_tokens
            yield rows(list(range(written, written + len(ids))), ids, [None] * len(ids))
            written += len(ids)
        if held:
            yield rows([blocks], [None], [np.concatenate(pending).tobytes()])

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, "file long, seq long, doc_id long, tokens binary")
        .write.option("compression", "zstd")
        .parquet(path)
    )


def find_separators(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """blocks(file, seq, tokens) -> (file, seq, n_tokens, ends array<int>), a row per block."""

    def run(batches):
        for batch in batches:
            sizes, ends = [], []
            for block in batch.column(2):
                ids = np.frombuffer(block.as_buffer() or b"", dtype=dtype)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ends) if ends else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), lists], names=["file", "seq", "n_tokens", "ends"])

    return blocks.select("file", "seq", "tokens").mapInArrow(run, "file long, seq long, n_tokens long, ends array<int>")


def stitch(found: DataFrame) -> DataFrame:
    """(file, seq, n_tokens, ends) -> (file, ordinal, n_tokens, closed), a row per document."""
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("file", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    has = F.size("ends") > 0
    # tokens behind the last separator; a block with a separator starts a new run of carried tokens
    tail = F.when(has, F.col("n_tokens") - 1 - F.element_at("ends", -1)).otherwise(F.col("n_tokens"))
    blocks = (
        found.withColumn("_tail", tail)
        .withColumn("_first", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("_run", F.coalesce(F.sum(has.cast("int")).over(before), F.lit(0)))
        .withColumn("_opened", F.lag(F.when(has, F.col("_tail"))).over(Window.partitionBy("file").orderBy("seq")))
    )
    # inside a run all blocks but its last lack separators; the run begins with the tail of the block before it
    carried = F.coalesce(F.sum("n_tokens").over(run), F.lit(0)) + F.coalesce(F.max("_opened").over(Window.partitionBy("file", "_run")), F.lit(0))
    blocks = blocks.withColumn("_carried", carried)
    closed = blocks.filter(has).select(
        "file",
        F.posexplode(
            F.zip_with(
                "ends",
                F.concat(F.array(-F.col("_carried") - 1), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda x: x.cast("long"))),
                lambda e, p: e - p - 1,
            )
        ).alias("_k", "n_tokens"),
        "_first",
    )
    closed = closed.select("file", (F.col("_first") + F.col("_k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    last = blocks.withColumn("_last", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("seq")))).filter("_last = 1")
    rest = F.when(has, F.col("_tail")).otherwise(F.col("_carried") + F.col("n_tokens"))
    unclosed = last.select("file", (F.col("_first") + F.size("ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return closed.unionByName(unclosed)


def count_files(spark: SparkSession, path: str, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """Token counts of the documents in token files that ``write_token_files`` made."""
    blocks = spark.read.parquet(path).filter(F.col("tokens").isNotNull())
    return stitch(checkpoint(find_separators(blocks, end_id, dtype)))


def count_flat(spark: SparkSession, path: str, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """The same for plain binary files of ids, each a block of its own (below 2 GB)."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), F.lit(0).cast("long").alias("seq"), F.col("content").alias("tokens"))
    return stitch(find_separators(files, end_id, dtype))


def token_counts(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> token files -> (doc_id, n_tokens), a row per document.

    The token files lie in the shared folder and go when the counts are made.
    """
    spark = docs.sparkSession
    at = scratch(spark, "tokens")
    write_token_files(docs, at, vocabulary, end_id, block_tokens, dtype, id_col, text_col)
    counts = count_files(spark, at, end_id, dtype)
    order = spark.read.parquet(at).filter(F.col("tokens").isNull()).select("file", F.col("seq").alias("ordinal"), "doc_id")
    out = checkpoint(order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens"))
    delete(spark, at)
    return out
