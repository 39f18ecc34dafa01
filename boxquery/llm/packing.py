"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are cut to pieces of at most a sequence; what the plan needs of them is how
many pieces there are of each length. Best fit, longest first, runs over those counts:
a step places all pieces of a length that one group of equal sequences takes. Pieces
are then ranked within their length and take the planned slots by rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.llm._common import blocks, table, written

SEQUENCE_TOKENS = 2048
MODEL = "byte_bpe_50k.json"
#: Ends every document.
END = 0
#: Texts with a longer run without a change between white space and other characters go to the slower library, whose time doesn't grow with the square of a run.
LONG_RUN = 4096
_RUN = rf"(?:\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}})"

Run = tuple[int, int, int, int, int, int]


class Encoder:
    """Token ids as the model's own library gives them.

    A byte-level model whose ranks are shipped too is read by the faster of the two
    libraries: the same pattern cuts the text, and merge k makes token 256 + k, which is
    looked at here, so both merge alike. Special strings in a text are their tokens.
    """

    def __init__(self, model: str = MODEL):
        import json
        import re

        import public_tokenizers
        import tokenizers

        path = model if "/" in model else public_tokenizers.path(model)
        self.plain = tokenizers.Tokenizer.from_file(path)
        self.long = re.compile(_RUN)
        self.fast = None
        if model != MODEL:
            return
        import base64

        import tiktoken

        with open(public_tokenizers.path(model.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        if len(ranks) == 256 + len(merges) and all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges)):
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = list(special)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self.long.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


_LOADED: dict[str, Encoder] = {}


def _encoder(model: str) -> Encoder:
    if model not in _LOADED:
        _LOADED[model] = Encoder(model)
    return _LOADED[model]


def token_pieces(docs: DataFrame, size: int = SEQUENCE_TOKENS, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """The pieces of every document, written: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    Also the task that made it and its rank among that task's pieces of its length. Only
    documents longer than ``size`` are cut; their first piece is the one that may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = _encoder(model), TaskContext.get().partitionId(), Counter()
        for batch in blocks(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text), END], "<u4")
                start, end = 0, (len(ids) - 1) % size + 1
                piece = 0
                while start < len(ids):
                    part = ids[start:end]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)], part.astype(np.int32) if with_ids else None))
                    seen[len(part)] += 1
                    piece, start, end = piece + 1, end, end + size
            *columns, ids = zip(*rows, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids array<int>" * with_ids
    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "pieces")


def plan(counts: dict[int, int], size: int = SEQUENCE_TOKENS) -> list[Run]:
    """Best fit, longest first, over the number of pieces of each length.

    Runs (length, first rank, pieces, pieces a sequence, first sequence, offset): the
    pieces of these ranks lie one after another from the offset on in consecutive
    sequences. Best fit puts equal pieces into the sequence with the least room until
    no more fits, then into the next; so a group of sequences of equal room takes them in
    one step, and its room falls below half of what it was. A length makes four new groups at most:
    there are fewer than 4 * size * log2(size) runs, whatever the number of documents.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room: groups of sequences (first, how many)
    runs: list[Run] = []
    made = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, sequences: int, free: int) -> int:
            """Fill ``sequences`` of them; how many were touched."""
            nonlocal left, rank
            each = free // length
            full = min(sequences, left // each)
            if full:
                runs.append((length, rank, full * each, each, first, size - free))
                room[free - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if left and full < sequences:  # fewer than a sequence takes
                runs.append((length, rank, left, left, first + full, size - free))
                room[free - left * length].append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            return full

        for free in range(length, size):
            while left and room[free]:
                first, sequences = room[free].pop()
                used = place(first, sequences, free)
                if used < sequences:
                    room[free].append((first + used, sequences - used))
            if not left:
                break
        if left:
            need = -(-left // (size // length))
            place(made, need, size)
            made += need
    return runs


def pack(docs: DataFrame, size: int = SEQUENCE_TOKENS, model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """Every piece with its sequence_id and its offset there; ``ids`` are its tokens.

    A null or empty text is the end token alone; rows that repeat are packed each, a null
    id stays null; other columns are ignored. A text of any length is cut, never shortened.
    Sequences are at most ``size`` long and have no gaps; the histogram of at most ``size`` lengths and
    the plan, whose size depends on ``size`` alone, are all that the driver sees.
    """
    pieces = token_pieces(docs, size, model, with_ids)
    each = written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = docs.sparkSession.createDataFrame(plan(counts, size), "length long, first long, n long, each long, sequence long, at long")
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(each.select("task", "length", ahead.alias("ahead")), ["task", "length"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    p, r = ranked.alias("p"), F.broadcast(runs.alias("r"))
    slot = F.col("p.rank") - F.col("r.first")
    placed = p.join(r, (F.col("p.length") == F.col("r.length")) & (slot >= 0) & (slot < F.col("r.n")))
    return placed.select(
        *(f"p.{c}" for c in pieces.columns if c not in ("task", "nth")),
        (F.col("r.sequence") + F.floor(slot / F.col("r.each"))).cast("long").alias("sequence_id"),
        (F.col("r.at") + slot % F.col("r.each") * F.col("p.length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, in order of the offsets; a sequence's pieces are few."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return rows.select("sequence_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias("ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
