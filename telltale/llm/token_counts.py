"""Token counts from a compiled tokenizer: transitions carry how many tokens they emit.

The tokenizer's merges are a deterministic transducer (``bpe.Transducer``); here a transition's output is only a count.
A text is taken in chunks. What a chunk does to a count depends on where it is entered only up to its first cut, a
white space after something else, and what it leaves open begins at its last cut. So a chunk's map from entry states to
counts is three parts: the open head, the count between the cuts, the open tail. Such maps compose associatively, and
the chunks of a text are combined by a prefix scan in pairs, in as many rounds as the logarithm of their number.

Defined cases. A null text counts as empty: no bytes, no tokens. Strings of special tokens inside a text are one token
each, as the tokenizer's own default has it. A text without any white space is one run and is counted as such. Repeated
rows are counted alike, each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import json
import re
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from telltale.llm.bpe import MEMO_PIECES, SPACE, PieceEncoder, read_ranks
from telltale.llm.common import per_batch
from telltale.sources.tables import table

COUNT_VOCABULARY = "byte_bpe_50k.json"
#: Tokens beyond which a document is over the limit.
LIMIT = 1_024
#: Characters of a chunk.
CHUNK = 1 << 15
_CUT = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")


class CountingTokenizer(PieceEncoder):
    """Counts tokens; special strings are taken out of the text first."""

    def __init__(self, path: str, pattern: str):
        super().__init__(read_ranks(path), pattern)
        added = json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"] if path.endswith(".json") else []
        special = [re.escape(t["content"]) for t in added if t["special"]]
        self._special = re.compile("|".join(special)) if special else None
        self._counts: dict[str, int] = {}

    def _count_piece(self, piece: str) -> int:
        """The sum of the counts on the transitions that the piece's bytes take."""
        machine, state, n = self.machine, 0, 0
        machine.make_room()
        states = machine.states
        for byte in piece.encode("utf-8", "surrogatepass"):
            step = states[state][5].get(byte)
            state, emitted = step if step is not None else machine._step(state, byte)
            n += len(emitted)
        n += len(machine.rest(state))
        if len(piece) <= 64:
            if len(self._counts) >= MEMO_PIECES:
                self._counts.clear()
            self._counts[piece] = n
        return n

    def count_run(self, text: str) -> int:
        """Tokens of a text, or of what lies between two cuts of one."""
        if self._special is not None and self._special.search(text):
            plain = self._special.split(text)
            return sum(map(self.count_run, plain)) + len(plain) - 1
        get, count = self._counts.get, self._count_piece
        return sum([get(piece) or count(piece) for piece in self.pieces(text)])

    def count(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.count_run(text)
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        return self.finish(self.scan(maps)[-1])

    def chunk_map(self, chunk: str) -> ChunkMap:
        first = _CUT.search(chunk)
        if first is None:
            return ChunkMap(chunk, 0, None)
        last = len(chunk)
        if chunk[-1] not in _SPACES:  # back over the last run
            while chunk[last - 1] not in _SPACES:
                last -= 1
        while chunk[last - 1] in _SPACES:  # and the white space before it
            last -= 1
        return ChunkMap(chunk[: first.start()], self.count_run(chunk[first.start() : last]), chunk[last:])

    def join(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two chunks that follow each other."""
        if a.tail is None and b.tail is None:
            return self.chunk_map(a.head + b.head)
        if a.tail is None:
            return self._with_head(a.head, b)
        glued = self.chunk_map(a.tail + b.head)  # its head is empty or a run that begins at a's last cut
        if b.tail is not None:
            return ChunkMap(a.head, a.count + self.finish(glued) + b.count, b.tail)
        if glued.tail is None:
            return ChunkMap(a.head, a.count, glued.head)
        return ChunkMap(a.head, a.count + self.count_run(glued.head) + glued.count, glued.tail)

    def _with_head(self, text: str, b: ChunkMap) -> ChunkMap:
        """A chunk without a cut before one with some."""
        glued = self.chunk_map(text + b.head)
        if glued.tail is None:
            return ChunkMap(glued.head, b.count, b.tail)
        return ChunkMap(glued.head, glued.count + self.count_run(glued.tail) + b.count, b.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefixes, by joining neighbours at doubling distances; the joins of a round don't depend on each other."""
        maps, distance = list(maps), 1
        while distance < len(maps):
            maps = maps[:distance] + [self.join(maps[i - distance], maps[i]) for i in range(distance, len(maps))]
            distance *= 2
        return maps

    def finish(self, whole: ChunkMap) -> int:
        return self.count_run(whole.head) + whole.count + (self.count_run(whole.tail) if whole.tail else 0)


_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


@dataclass(frozen=True)
class ChunkMap:
    """Before the first cut, tokens from there to the last cut, and from the last cut on; without a cut all is head."""

    head: str
    count: int
    tail: str | None


@cache
def counting_tokenizer(path: str, pattern: str) -> CountingTokenizer:
    """One per worker process. What it keeps is bounded and has no cycles, so the collector need not search it often."""
    gc.set_threshold(200_000, 50, 1_000)
    return CountingTokenizer(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def start():
        tokenizer = counting_tokenizer(path, pattern)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.array([tokenizer.count(t) for t in texts], np.int64)
            size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            return {
                "doc_id": batch.column(0),
                "n_bytes": pa.array(size),
                "n_tokens": pa.array(n),
                "over_limit": pa.array(n > limit),
            }

        return step

    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return per_batch(docs.select("doc_id", "text"), schema, start)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(COUNT_VOCABULARY)
    return count_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
