"""Mixture-controlled packing.

Sources are queues of documents, served by deficit round-robin: each round (one window's worth of tokens) adds
to a queue's deficit its share of the window, and the queue then sends the documents that its deficit pays for,
carrying the rest on. While a queue has documents, its deficit after round r is r times its share less what it
has sent; so a document goes out in the first round r with r * share >= the queue's tokens up to its end. That
closed form makes the rounds a matter of running totals: no task walks through the queues, and deficits carry
over windows and partitions alike. Documents in the order of (round, queue, row) are one stream of tokens,
which is cut every ``window`` tokens. What is left at the end is cut into powers of two. There is no padding.

Running totals are sums in blocks that are bounded by construction (rows of a queue that were read together;
the rounds of a stretch, which hold as many tokens as windows), then sums of the blocks' totals, so a source may
hold any part of the rows.

Defined results: null texts are empty and consist of the end token; a null source is the queue ''; each
source is a queue of its own (the queues are broadcast up to ``max_queues``, and joined beyond); repeated rows and ids are packed one by one; an empty
table gives no rows. Without target shares, a queue's share is its part of all tokens, and all queues last
until the end. A queue with a target of 0 or none is served after all others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tokens import encoder
from millrace.plans.scratch import write_table

#: Rounds in a block of the stream, rows in a block of a queue, blocks in a block of blocks.
_ROUNDS, _ROWS, _BLOCKS = 256, 4096, 4096


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row, doc_id, source, n_tokens, ids (little-endian, 16 bits if the vocabulary allows, else 32) of every row.

    The table is written once, as both the lengths and the ids of it are needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.size - 1, end_id) < 1 << 16 else "<u4"
        for batch in batches:
            ids = [np.append(enc.ids(t or ""), end_id).astype(kind).tobytes() for t in batch.column(3).to_pylist()]
            size = int(kind[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["row", "doc_id", "source", "n_tokens", "ids"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).cast("string").alias("text"),
    )
    return write_table(rows.mapInArrow(run, "row long, doc_id long, source string, n_tokens long, ids binary"), "tokens", compression="zstd")


def _before(df: DataFrame, key: list[str], block: str, size: str, out: str) -> DataFrame:
    """key, block and the total size of the key's blocks before, by way of blocks of blocks."""
    totals = df.groupBy(*key, block).agg(F.sum(size).alias("own")).withColumn("upper", F.floor(F.col(block) / _BLOCKS))
    uppers = totals.groupBy(*key, "upper").agg(F.sum("own").alias("upper_own"))
    over = Window.partitionBy(*key or [F.lit(0)]).orderBy("upper")
    uppers = uppers.select(*key, "upper", (F.sum("upper_own").over(over) - F.col("upper_own")).alias("upper_before"))
    inside = Window.partitionBy(*key, "upper").orderBy(block)
    totals = totals.withColumn("inside", F.sum("own").over(inside) - F.col("own"))
    return totals.join(uppers, [*key, "upper"]).select(*key, block, (F.col("upper_before") + F.col("inside")).alias(out))


def layout(lengths: DataFrame, window: int = 2048, shares: dict[str, float] | None = None, max_queues: int = 1024) -> DataFrame:
    """row, round and start (place of the first token in the stream) for rows of (row, source, n_tokens)."""
    totals = lengths.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    few = totals.limit(max_queues + 1).count() <= max_queues
    if shares is None:
        share = F.col("tokens").cast("double")
    else:
        spark = lengths.sparkSession
        targets = spark.createDataFrame([(q, max(0.0, float(x))) for q, x in shares.items()], "source string, share double")
        totals, share = totals.join(targets, "source", "left"), F.coalesce("share", F.lit(0.0))
    whole = totals.agg(F.sum(share)).first()[0] or 1.0
    queues = totals.select(F.col("source").alias("queue"), "tokens", (share / F.lit(whole) * window).alias("quantum"))
    last = 2 + (queues.filter("quantum > 0").agg(F.max(F.floor(F.col("tokens") / F.col("quantum")))).first()[0] or 0)
    queues = queues.select("queue", "quantum")
    rows = lengths.select("row", "n_tokens", F.col("source").alias("queue"), F.expr(f"(row >> 33) * {(1 << 33) // _ROWS} + ((row & {(1 << 33) - 1}) div {_ROWS})").alias("block"))
    rows = rows.join(F.broadcast(queues) if few else queues.hint("merge"), "queue")
    within = Window.partitionBy("queue", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("upto", F.sum("n_tokens").over(within)).join(
        _before(rows, ["queue"], "block", "n_tokens", "queue_before"), ["queue", "block"]
    )
    end = F.col("queue_before") + F.col("upto")
    # a queue without a share follows when all others have ended, at a window's worth for each round
    served = F.when(F.col("quantum") > 0, F.ceil(end / F.col("quantum"))).otherwise(F.lit(last) + F.ceil(end / F.lit(window)))
    stream = ends.select("row", "queue", "n_tokens", served.cast("long").alias("round"))
    stream = stream.withColumn("stretch", F.floor(F.col("round") / _ROUNDS))
    within = Window.partitionBy("stretch").orderBy("round", "queue", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = stream.withColumn("upto", F.sum("n_tokens").over(within)).join(
        _before(stream, [], "stretch", "n_tokens", "stream_before"), "stretch"
    )
    return placed.select("row", "round", (F.col("stream_before") + F.col("upto") - F.col("n_tokens")).alias("start"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    shares: dict[str, float] | None = None,
    max_queues: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: a row per piece.

    A sequence is its pieces in the order of offset. All sequences have ``window`` tokens but the last few,
    which have falling powers of two.
    """
    tokens = tokenize(docs, tokenizer, end_id, id_col, text_col, source_col)
    lengths = tokens.select("row", "source", "n_tokens")
    everything = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    full, rest = divmod(everything, window)
    starts, at = [], full * window
    for power in range(window.bit_length(), -1, -1):
        if rest >> power & 1:
            starts.append(at)
            at += 1 << power
    starts = np.array(starts, np.int64)
    places = layout(lengths, window, shares, max_queues).select("row", F.col("start").alias("place"))
    rows = tokens.join(places, "row").select("doc_id", "source", "n_tokens", "ids", "place")

    def cuts(place: int, n: int) -> np.ndarray:
        """Where, in the stream, pieces of this stretch begin."""
        first = np.arange(-(-place // window) * window, min(place + n, full * window), window)
        return np.unique(np.concatenate(([place], first, starts[(starts > place) & (starts < place + n)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, start, length, sequence, offset, ids = [], [], [], [], [], []
            lengths, blobs, places = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for i, (n, blob, place) in enumerate(zip(lengths, blobs, places, strict=True)):
                values = np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4")
                at = cuts(place, n)
                for a, b in zip(at, [*at[1:], place + n], strict=True):
                    k = a // window if a < full * window else full + int(np.searchsorted(starts, a, "right")) - 1
                    which.append(i)
                    start.append(a - place)
                    length.append(b - a)
                    sequence.append(k)
                    offset.append(a - (k * window if a < full * window else starts[k - full]))
                    ids.append(values[a - place : b - place].tobytes())
            took = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(took),
                    batch.column(1).take(took),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    batch.column(2).take(took),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                ],
                names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return rows.mapInArrow(
        run, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def pack_digest(pieces: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source of pack()'s pieces."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
