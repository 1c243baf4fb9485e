"""Problem 7: a whole corpus as token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every function that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how this vocabulary cuts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without the characters of UNUSUAL, for the faster standard module.
USUAL_PIECES = r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Numbers that aren't decimal digits, and characters that only one of the modules takes for white space.
UNUSUAL = r"[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe]|[^\W\d_a-zA-Z\xaa\xb5\xba\xc0-ɏͰ-ϿЀ-ҁҊ-ԯぁ-ゖァ-ヺ一-鿿가-힣Ａ-Ｚａ-ｚ]"

MEMO_PIECES = 250_000
MEMO_LENGTH = 24


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece.

    Symbols are a doubly linked list over the bytes; a queue holds the rank of every pair of neighbours. The pair of the
    least rank, the leftmost first, is merged; entries of pairs that no longer stand side by side are skipped.
    """
    n = len(piece)
    if n < 3:
        whole = ranks.get(piece)
        return [whole] if whole is not None else [ranks[piece[i : i + 1]] for i in range(n)]
    end = list(range(1, n + 1))  # of the symbol that starts here
    before = list(range(-1, n - 1))  # start of the symbol before
    get = ranks.get
    queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        _, i, mid, stop = pop(queue)
        if end[i] != mid or end[mid] != stop:
            continue
        end[i] = stop
        end[mid] = -1
        if stop < n:
            before[stop] = i
            after = end[stop]
            if (r := get(piece[i:after])) is not None:
                push(queue, (r, i, stop, after))
        left = before[i]
        if left >= 0 and (r := get(piece[left:stop])) is not None:
            push(queue, (r, left, i, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder(dict):
    """Piece of text -> token ids, with the last pieces remembered. Missing pieces are merged."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        super().__init__()
        self.ranks = ranks
        self.usual, self.unusual, self.any = re.compile(USUAL_PIECES), re.compile(UNUSUAL), regex.compile(PIECES)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple(merge_piece(raw, self.ranks))
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        return (self.any if self.unusual.search(text) else self.usual).findall(text)

    def encode(self, text: str | None) -> chain:
        return chain.from_iterable(map(self.__getitem__, self.pieces(text))) if text else chain()

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.pieces(text)))) if text else 0

    @cached_property
    def strings(self) -> dict[int, bytes]:
        return {i: s for s, i in self.ranks.items()}

    def decode(self, ids: Iterable[int]) -> str:
        """The text behind the ids: their vocabulary strings, one after the other."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


#: Encoders that a Python worker has built, by vocabulary: tasks that share a worker share its vocabulary and remembered pieces.
_ENCODERS: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(data))
    return _ENCODERS[key]


def token_ids(documents: DataFrame, *, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """ident, ids (array<int>) of every row: whole texts, no special tokens. Null and empty texts have no ids; repeated rows stay repeated."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for t in batch.column(1).to_pylist():
                ids.extend(encoder.encode(t))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [ident, "ids"])

    kind = documents.schema[ident].dataType.simpleString()
    return documents.select(ident, text).mapInArrow(run, f"`{ident}` {kind}, ids array<int>")


def decoded(encoded: DataFrame, *, ident: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """ident, text of every row of ids: vocabulary strings concatenated. No ids give an empty text, null ids a null one."""
    with open(vocabulary, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [ident, "text"])

    kind = encoded.schema[ident].dataType.simpleString()
    return encoded.select(ident, "ids").mapInArrow(run, f"`{ident}` {kind}, text string")
