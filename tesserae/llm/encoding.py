"""Problem 6: encoding of a corpus with a public byte-level tokenizer."""

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

NONE = 1 << 60  # no merge
SHORT = 96  # bytes; a longer word is merged with a heap, for the scans' time grows with the square of the length
WORDS = 200_000  # words whose ids a task remembers at most


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank, which is its id, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: one array of boundaries, and one of the ranks that joining two neighbouring parts would have."""
    edges = list(range(len(word) + 1))
    joined = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while joined and (low := min(joined)) != NONE:
        i = joined.index(low)
        del edges[i + 1], joined[i]
        if i < len(joined):
            joined[i] = ranks.get(word[edges[i] : edges[i + 2]], NONE)
        if i:
            joined[i - 1] = ranks.get(word[edges[i - 1] : edges[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(edges, edges[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids with a heap of joins, in n log n steps."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if end[i] < 0 or end[i] >= n or end[end[i]] != stop:  # one of the two parts has changed since
            continue
        gone = end[i]
        end[i], end[gone] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]], NONE)) != NONE:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop], NONE)) != NONE:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Texts to ids; remembers words it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split, self.known = ranks, regex.compile(pattern).findall, {}

    def word(self, word: str) -> list[int]:
        if (ids := self.known.get(word)) is None:
            raw = word.encode("utf-8", "replace")
            ids = [self.ranks[raw]] if raw in self.ranks else (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
            if len(raw) <= SHORT:
                if len(self.known) >= WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def text(self, text: str | None) -> list[int]:
        return [i for w in self.split(text) for i in self.word(w)] if text else []


def public_encoder(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """The ranks and the pattern that splits words, for the tasks: by default those of byte_bpe_50k.

    The file is read once, on the driver; its size is that of the vocabulary.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return spark.sparkContext.broadcast((read_ranks(path), pattern))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key and ids (array<int>) of each row: its text as it stands in the ids of a public tokenizer, without special tokens.

    An empty or null text gives an empty list; a blank one is encoded. Strings of special tokens are ordinary text.
    Every row gives a row, repeated ones too; other columns don't matter. A text is never cut.
    """
    held = public_encoder(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*held.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = pa.array([encoder.text(t) for t in part[1].to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part[0], ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")
