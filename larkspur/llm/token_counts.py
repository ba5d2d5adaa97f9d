"""Token counts of documents in flat token files, by a separator scan.

A flat token file is a run of token ids without an index; an end-of-document id closes each document.
Here a file is kept as a table of fixed-size blocks (file_id, block, n, ids: packed little-endian uint32 or
uint16), in file order. Each block is searched for separators with one vectorised comparison; a window over
the block summaries (a prefix scan) gives every block the number of documents and tokens open before it,
which stitches documents that cross block boundaries.

Edge cases: an empty document counts 0 tokens; null text counts as empty; tokens after a file's last
separator are an unclosed document, which is reported with `closed` false; a file without tokens has no
blocks and no rows; a text holding the separator's own string is encoded as ordinary text; a text of any length is
one run of ids, cut into blocks; repeated rows are documents of their own; an empty table gives no rows; other columns
of the input are ignored; a vocabulary whose ids do not fit the type is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.scratch import small_batches, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 18


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encode_flat(docs: DataFrame, ranks: dict[bytes, int], pattern: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode documents into flat files, one per task, written once to the shared folder.

    Rows with ids are blocks of a file; rows with doc_id are its manifest: the ordinal of each document.
    """
    small_batches(docs.sparkSession)
    if max(separator, *ranks.values()) > np.iinfo(np.uint16).max:
        raise ValueError("token ids do not fit 16 bits")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary, of fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        file_id, block, ordinal, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, held, size
            ids = np.concatenate(held) if held else np.zeros(0, np.uint16)
            while len(ids) >= block_tokens or (last and len(ids)):
                piece, ids = ids[:block_tokens], ids[block_tokens:]
                yield batch([block], [len(piece)], [piece.tobytes()], [None], [None])
                block += 1
            held, size = [ids], len(ids)

        def batch(blocks, n, ids, ordinals, doc_ids):
            arrays = [pa.array([file_id] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(ordinals, pa.int64()), pa.array(doc_ids, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["file_id", "block", "n", "ids", "ordinal", "doc_id"])

        end = np.array([separator], np.uint16)
        for b in parts:
            n = b.num_rows
            for text in b.column("text").to_pylist():
                if text:
                    ids = coder.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
                    held.append(ids)
                    size += len(ids)
                held.append(end)
                size += 1
                if size >= block_tokens:
                    yield from flush(False)
            none = [None] * n
            yield batch(none, none, none, list(range(ordinal, ordinal + n)), b.column("doc_id").to_pylist())
            ordinal += n
        yield from flush(True)

    flat = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file_id long, block long, n long, ids binary, ordinal long, doc_id long")
    return written(flat, "flat_tokens")


def scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "uint16") -> DataFrame:
    """file_id, ordinal, n_tokens, closed for every document of flat files given as (file_id, block, n, ids)."""

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            at = [np.flatnonzero(np.frombuffer(x.as_buffer(), dtype) == separator) for x in b.column("ids")]
            ends = [pa.array(x, pa.int32()) for x in at]
            lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in ends]).astype(np.int32), pa.concat_arrays(ends) if ends else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("block"), b.column("n"), lists], ["file_id", "block", "n", "ends"])

    found = blocks.select("file_id", "block", "n", "ids").mapInArrow(search, "file_id long, block long, n long, ends array<int>")
    # The scan runs over counts only, a short row for each block; the places of separators stay with their block.
    order = Window.partitionBy("file_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n_ends, last_end = F.size("ends"), F.when(F.size("ends") > 0, F.element_at("ends", -1))
    counts = found.select("file_id", "block", "n", n_ends.alias("n_ends"), last_end.alias("last_end"))
    counts = counts.withColumns({"start": F.coalesce(F.sum("n").over(before), F.lit(0)), "docs": F.coalesce(F.sum("n_ends").over(before), F.lit(0)), "last_block": F.lead("block").over(order).isNull()})
    counts = counts.withColumn("prior", F.coalesce(F.max(F.col("start") + F.col("last_end")).over(before), F.lit(-1)))
    stitched = found.select("file_id", "block", "ends").join(counts.select("file_id", "block", "docs", "prior", "start"), ["file_id", "block"])
    closed = stitched.select("file_id", "docs", "prior", "start", F.posexplode("ends").alias("i", "at"), "ends").select(
        "file_id",
        (F.col("docs") + F.col("i")).alias("ordinal"),
        (F.col("start") + F.col("at") - F.when(F.col("i") == 0, F.col("prior")).otherwise(F.col("start") + F.get("ends", F.col("i") - 1)) - 1).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    tail = F.col("start") + F.col("n") - 1 - F.greatest("prior", F.coalesce(F.col("start") + F.col("last_end"), F.lit(-1)))
    rest = counts.where("last_block").select("file_id", (F.col("docs") + F.col("n_ends")).alias("ordinal"), tail.alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.unionByName(rest)


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    flat = encode_flat(docs, load_ranks(), public_tokenizers.PATTERN)
    counts = scan(flat.where("ids IS NOT NULL").select("file_id", "block", "n", "ids"))
    manifest = flat.where("ids IS NULL").select("file_id", "ordinal", "doc_id")
    return manifest.join(counts, ["file_id", "ordinal"]).select("doc_id", "n_tokens")
