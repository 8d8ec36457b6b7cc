"""Token ids of whole texts by replaying the merges of a byte-level vocabulary over all words at once.

``token_ids``: a task keeps the differing words of its documents as one sequence of symbols. An inverted index leads from a
pair of symbols to the positions where it stands; merges are applied in rank order to all of these positions, and only
the pairs at the two neighbours of a merged position are entered anew. Words met before keep their ids, so that
the work follows the number of differing words. Documents are never cut, regrouped or exchanged for it.
``corpus_token_ids`` replays each differing word of the whole corpus once and gives the same ids, but has to exchange every
word of every text to bring them back (figures in the README).

``<|endoftext|>`` and the like inside a text are ordinary text. Null and empty texts have an empty list.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.hotkeys import join_hot
from quillstone.session import Scratch

TOKENIZERS = os.environ.get("QUILLSTONE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
#: How byte-level vocabularies split text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 200_000  # a task forgets its words beyond that and meets them anew
CHARS_AT_ONCE = 2_000_000  # texts are split into words so many characters at a time, always whole texts


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class MergeReplay:
    """Ids of words by corpus-level replay of a merge table."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.first = [vocab[c] for c in _byte_letters()]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def learn(self, words: list[str]) -> None:
        """Enters the ids of ``words``, which must differ."""
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        symbol: list[int] = []
        starts = [0]
        first = self.first
        for w in words:
            symbol.extend(first[b] for b in w.encode("utf-8"))
            symbol.append(-1)  # ends the word: no pair holds it
            starts.append(len(symbol))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, index = self.rank, {}
        for i, pair in enumerate(zip(symbol, symbol[1:])):
            if (r := rank.get(pair)) is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            a, b = self.pairs[r]
            new = self.made[r]
            for i in sorted(index.pop(r)):  # from the left, as in "aaa"
                j = after[i]
                if symbol[i] != a or j >= n or symbol[j] != b:
                    continue  # a merge of this or an earlier rank took one of the two
                symbol[i], symbol[j] = new, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (q := rank.get((new, symbol[k]))) is not None:
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
                            heapq.heappush(heap, q)
                h = before[i]
                if h >= 0 and (q := rank.get((symbol[h], new))) is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heapq.heappush(heap, q)
        for w, s, e in zip(words, starts, starts[1:]):
            self.words[w] = [x for x in symbol[s : e - 1] if x >= 0]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else () for t in texts]
        known = self.words
        if new := {w for ws in split for w in ws if w not in known}:
            if len(known) > KEPT_WORDS:  # learn() starts afresh: all words of these texts are needed
                new = {w for ws in split for w in ws}
            self.learn(sorted(new))
            known = self.words
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w]
            out.append(ids)
        return out


_LOADED: dict[str, MergeReplay] = {}


def replay_of(path: str) -> MergeReplay:
    """The vocabulary at ``path``, read once a worker."""
    if path not in _LOADED:
        _LOADED[path] = MergeReplay(path)
    return _LOADED[path]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS_AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_ids(documents: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(id_column, ids array<int>)`` of every row, repeated ones included."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    source = documents.select(id_column, text)
    kind = source.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in _blocks(texts):
                lists = replay.encode(texts[s:e])
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [id_column, "ids"])

    return source.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def corpus_token_ids(documents: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """As ``token_ids``: the corpus's differing words, each in one task, are replayed once and joined to where they stand."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    scratch = Scratch(documents.sparkSession)
    rows = scratch.write(documents.select(id_column, text).withColumn("_row", F.monotonically_increasing_id()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = replay_of(path).split
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    w = words(t)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(w), pa.int64()), pa.array(range(len(w)), pa.int32()), pa.array(w, pa.string())], ["_row", "_at", "_word"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(path)
        for b in batches:
            words = b.column(0).to_pylist()
            replay.words = {}
            replay.learn(words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([replay.words[w] for w in words], pa.list_(pa.int32()))], ["_word", "_ids"])

    stand = scratch.write(rows.select("_row", text).mapInArrow(split, "_row bigint, _at int, _word string"))
    known = scratch.write(stand.select("_word").distinct().mapInArrow(learn, "_word string, _ids array<int>"))
    put = join_hot(stand, known, "_word").groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_ids"))), lambda x: x["_ids"])).alias("ids"))
    return rows.select(id_column, "_row").join(put, "_row", "left").select(id_column, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def token_counts(documents: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(id_column, n_tokens int)`` of every row."""
    path = path or f"{TOKENIZERS}/{BYTE_BPE}"
    source = documents.select(id_column, text)
    kind = source.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = [len(x) for s, e in _blocks(texts) for x in replay.encode(texts[s:e])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32())], [id_column, "n_tokens"])

    return source.mapInArrow(run, f"`{id_column}` {kind}, n_tokens int")


def source_tokens(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Tokens and documents by source."""
    return documents.select("doc_id", "source").join(ids.select("doc_id", F.size("ids").alias("n")), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))
