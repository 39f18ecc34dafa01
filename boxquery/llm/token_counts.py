"""Token counts by a compiled finite-state transducer.

The transducer reads characters. Its states are the open pieces of text between
two cuts that no vocabulary entry spans (before a run of spaces, before a run of
line ends); a transition that closes a piece emits the number of tokens of that
piece, and returns to the start state. Transitions are compiled on demand: the
emission of a piece is asked once from the tokenizer library and kept.

A chunk of text read from an unknown state is a state map: the piece it
completes (``head``), the tokens of its whole pieces (``emitted``) and the piece
it leaves open (``tail``). Maps compose associatively, so the chunks of a long
text are mapped one by one and joined by a prefix scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.llm._common import table

#: Characters of a chunk; a text of more is joined from the maps of its chunks.
CHUNK_CHARS = 1 << 13
KEPT_EMISSIONS = 300_000
BLOCK_CHARS = 1 << 21
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

_PIECE = re.compile(r" +[^ \n]*|\n+[^ \n]*")
_CUT = re.compile(r"(?<=[^ ])(?= )|(?<=[^\n])(?=\n)")


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to any state: ``tail`` is None while no cut has been read."""

    head: str
    emitted: int
    tail: str | None


class PieceTransducer:
    """Counts of a sentencepiece model: a dummy space first, spaces and U+2581 alike, no special tokens."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in normal):
            raise ValueError("a vocabulary entry spans a cut of this transducer")
        self.emits: dict[str, int] = {}

    def compile(self, pieces: set[str]) -> None:
        """Annotate the transitions that close ``pieces`` with their token counts."""
        if len(self.emits) > KEPT_EMISSIONS:
            self.emits.clear()
        new = [p for p in pieces if p not in self.emits]
        # a piece of spaces gets back the one space that the library puts first; a piece of line ends has that space's token too much
        asked = [p[1:] if p[0] == " " and len(p) > 1 else p if p[0] == "\n" else "\n" for p in new]
        for piece, ids in zip(new, self.library.encode(asked, num_threads=1), strict=True) if new else ():
            self.emits[piece] = len(ids) - (piece[0] == "\n" or piece == " ")

    def emission(self, piece: str) -> int:
        if piece not in self.emits:
            self.compile({piece})
        return self.emits[piece]

    @staticmethod
    def symbols(text: str) -> str:
        return " " + text.replace("▁", " ") if text else ""

    def chunk_map(self, symbols: str) -> StateMap:
        """The state map of a chunk of symbols read from an unknown state."""
        cuts = [m.start() for m in _CUT.finditer(symbols)]
        if not cuts:
            return StateMap(symbols, 0, None)
        pieces = _PIECE.findall(symbols, cuts[0], cuts[-1])
        self.compile(set(pieces))
        return StateMap(symbols[: cuts[0]], sum(map(self.emits.__getitem__, pieces)), symbols[cuts[-1] :])

    def compose(self, first: StateMap, then: StateMap) -> StateMap:
        joint = (first.head if first.tail is None else first.tail) + then.head
        cut = _CUT.search(joint)  # what is open on both sides has no cut but at the seam
        if cut is None:
            if first.tail is None:
                return StateMap(joint, then.emitted, then.tail)
            if then.tail is None:
                return StateMap(first.head, first.emitted, joint)
            return StateMap(first.head, first.emitted + self.emission(joint) + then.emitted, then.tail)
        left, right = joint[: cut.start()], joint[cut.start() :]
        head, emitted = (left, 0) if first.tail is None else (first.head, first.emitted + self.emission(left))
        if then.tail is None:
            return StateMap(head, emitted, right)
        return StateMap(head, emitted + self.emission(right) + then.emitted, then.tail)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Compose neighbours until one map is left: the last value of the parallel prefix scan."""
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        symbols = self.symbols(text)
        if not symbols:
            return 0
        end = self.scan([self.chunk_map(symbols[i : i + chunk]) for i in range(0, len(symbols), chunk)])
        return end.emitted + sum(self.emission(p) for p in (end.head, end.tail) if p)

    def counts(self, texts: list[str]) -> list[int]:
        """Counts of many texts; those of one chunk share the compile step."""
        out = [0] * len(texts)
        start = 0
        while start < len(texts):
            read: list[tuple[int, list[str]]] = []
            chars, need = 0, set()
            while start < len(texts) and chars < BLOCK_CHARS:
                text = texts[start]
                if len(text) > CHUNK_CHARS:
                    out[start] = self.count(text)
                else:
                    pieces = _PIECE.findall(self.symbols(text))
                    need.update(pieces)
                    read.append((start, pieces))
                chars += len(text)
                start += 1
            self.compile(need)
            for k, pieces in read:
                out[k] = sum(map(self.emits.__getitem__, pieces))
        return out


_LOADED: dict[str, PieceTransducer] = {}


def _transducer(model: str) -> PieceTransducer:
    if model not in _LOADED:
        if "/" in model:
            path = model
        else:
            import public_tokenizers

            path = public_tokenizers.path(model)
        _LOADED[model] = PieceTransducer(path)
    return _LOADED[model]


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text; one narrow pass, no shuffle.

    ``model`` is a file name of the installed tokenizer package or a path that every
    executor can read. Null and empty texts have no bytes and no tokens; rows that
    repeat are counted each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(model)
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            counts = transducer.counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)
