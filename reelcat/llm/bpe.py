"""BPE encoding and decoding with forced boundaries.

A merge can only make a token of the vocabulary, so two neighbouring bytes that
stand next to each other in no token are never merged: the place between them is a
certain cut.  Every piece of a text (after the tokenizer's normalisation and its
splitting rule) falls into fragments at such cuts; each fragment is merged on its
own, in time n log n, and the ids are put together.  Spaces stand in no token, so words are fragments
that can be remembered; each worker holds the latest of them up to a fixed number of bytes (and the words of one text).

The tokenizer file (``tokenizers`` JSON: BPE with byte letters and an end-of-word
suffix) is read on the driver from a path that the caller gives and broadcast; its
size is fixed.

Defined cases: a null text is empty and has no ids; decoding null or no ids gives
an empty text; special tokens written in a text are the special tokens; repeated rows are
encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import column, per_worker

#: the tokenizer's splitting rule on normalised text, where the only white space is a space (fixed value)
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+"
#: bytes of remembered words and their ids in a worker, with what Python adds to each
REMEMBERED, ADDED = 120_000_000, 200
#: parts of a fragment up to which a plain search for the next merge is faster than a heap
FEW = 48
#: rows in an outgoing batch
SLICE = 500
_SPLIT, _LETTER, _NUMBER = regex.compile(PIECES).findall, regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ForcedBoundaryBPE:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        said = json.loads(spec)
        model = said["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.names = {k: t for t, k in (self.vocab | self.special).items()}
        tokenizer = Tokenizer.from_str(spec)
        self.normalize = tokenizer.normalizer.normalize_str
        self.library_pieces = tokenizer.pre_tokenizer.pre_tokenize_str
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.letters = byte_letters()
        number = {c: b for b, c in enumerate(self.letters)}
        together = {pair for t in self.vocab for pair in pairwise(number[c] for c in t.removesuffix(self.end))}
        self.apart = {(a, b) for a in range(256) for b in range(256)} - together
        self.usual, self.odd = set(map(chr, range(33, 127))), set()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.size = 0

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut wherever two bytes stand together in no token."""
        cuts = [i for i, pair in enumerate(pairwise(piece), 1) if pair in self.apart]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    def merge(self, fragment: bytes, last: bool) -> list[int]:
        """Ids of one fragment: the earliest merge first, the leftmost of equals."""
        parts = [self.letters[b] for b in fragment]
        if last:
            parts[-1] += self.end
        return [self.vocab[p] for p in (self._few(parts) if len(parts) <= FEW else self._many(parts)) if p in self.vocab]

    def _few(self, parts: list[str]) -> list[str]:
        never, rank = len(self.ranks), self.ranks.get
        ranks = [rank(pair, never) for pair in pairwise(parts)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
        return parts

    def _many(self, parts: list[str]) -> list[str]:
        """The same with a heap of pairs over a linked list, in n log n; a pair that has changed since is passed over."""
        rank, n = self.ranks.get, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, pair in enumerate(pairwise(parts)) if (r := rank(pair)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or rank((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heappush(heap, (r, h))
        return [p for p in parts if p is not None]

    def pieces(self, word: str) -> list[str]:
        """By the splitting rule.  A letter that the library's Unicode tables class otherwise sends its word to the library's splitter."""
        for c in set(word) - self.usual:
            kind = "L" if _LETTER(c) else "N" if _NUMBER(c) else "O"
            found = self.library_pieces("a" + c + "!")
            said = "N" if len(found) == 3 else "L" if found[0][1] == (0, 2) else "O"
            self.usual.add(c)
            if kind != said:
                self.odd.add(c)
        if self.odd.isdisjoint(word):
            return _SPLIT(word)
        return [word[i:j] for _, (i, j) in self.library_pieces(word)]

    def word(self, word: bytes) -> bytes:
        """Ids of a stretch without spaces, as int32."""
        ids: list[int] = []
        for piece in self.pieces(word.decode()):
            *inner, last = self.fragments(piece.encode())
            for f in inner:
                ids += self.merge(f, False)
            ids += self.merge(last, True)
        return np.array(ids, np.int32).tobytes()

    def _plain(self, text: str) -> bytes:
        """No token has a space inside, so the places beside spaces are forced boundaries for all texts."""
        words = text.encode().lower().split() if text.isascii() else self.normalize(text).encode().split(b" ")
        if self.size >= REMEMBERED // 2:
            self.before, self.known, self.size = self.known, {}, 0
        known, before = self.known, self.before
        for w in set(words).difference(known):
            ids = known[w] = before[w] if w in before else self.word(w)
            self.size += len(w) + len(ids) + ADDED
        return b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        if "<" not in text or len(parts := self.at_special(text)) == 1:
            return np.frombuffer(self._plain(text), np.int32)
        return np.concatenate([[self.special[p]] if k % 2 else np.frombuffer(self._plain(p), np.int32) for k, p in enumerate(parts)]).astype(np.int32)

    def decode(self, ids) -> str:
        """Tokens joined by a space, as the library does for a tokenizer without a decoder; unknown ids give nothing."""
        names = self.names
        try:
            return " ".join(map(names.__getitem__, ids))
        except KeyError:
            return " ".join(names[k] for k in ids if k in names)


def _encoded(spec, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(("bpe", hash(spec.value)), lambda: ForcedBoundaryBPE(spec.value))
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                ids = [bpe.encode(t or "") for t in column(b, "_text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                found = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))]
                if decode:
                    found.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.string()))
                own = [n for n in b.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays([*(column(b, n) for n in own), *found], names=[*own, "_ids", *["_decoded"] * decode])

    return run


def _decoded(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(("bpe", hash(spec.value)), lambda: ForcedBoundaryBPE(spec.value))
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                texts = [bpe.decode(x or ()) for x in column(b, "_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "_decoded"])

    return run


def read_spec(docs: DataFrame, tokenizer_json: str):
    with open(tokenizer_json, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, tokenizer_json: str, keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """The columns in ``keep`` and ids (array of int) for every row; with ``decode`` also the text decoded from the ids."""
    own = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    out = own.drop("_text").withColumn("_ids", F.array().cast("array<int>"))
    out = out.withColumn("_decoded", F.lit("")) if decode else out
    found = own.mapInArrow(_encoded(read_spec(docs, tokenizer_json), decode), out.schema)
    names = {**{f"_k{i}": c for i, c in enumerate(keep)}, "_ids": "ids", "_decoded": "decoded"}
    return found.select(*(F.col(c).alias(names[c]) for c in found.columns))


def decode_documents(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """The columns of ``encoded`` (which has ids) and the decoded text."""
    own = encoded.withColumnRenamed("ids", "_ids")
    out = own.withColumn("_decoded", F.lit("")).schema
    return own.mapInArrow(_decoded(read_spec(encoded, tokenizer_json)), out).withColumnsRenamed({"_ids": "ids", "_decoded": "decoded"})
