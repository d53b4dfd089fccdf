"""Token counts by rank-synchronous merging of byte-pair symbols.

Texts are normalised and cut as the tokenizer file says. Pieces not met before are held together as ragged numpy
arrays of symbols; in each round every piece applies its own lowest-rank pair, all pieces at once, until none has a
mergeable pair, and the surviving symbols are counted. Counts are kept per piece in a bounded table of the task.

Only files of the supported shape (BPE over byte symbols with an end-of-word suffix, NFC, lower case, white space
dropped) are taken; others raise an error. Defined results: a null text is empty, with 0 bytes and 0 tokens; texts
are never truncated; special strings inside a text count as one token each, as the library does by default. Each row
gives a row, repeated ones and those without a doc_id too. Extra columns, whatever their names, are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Documents of more tokens are over the limit.
LIMIT = 2048
#: Pieces whose counts a task keeps.
KEPT_PIECES = 200_000
NONE = np.iinfo(np.int32).max
#: White space as Unicode has it; Python's str.split also cuts at these four.
_SPACE = r"\t-\r \x85\p{Z}"
_ODD = "\x1c\x1d\x1e\x1f"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class PairMerger:
    """Symbols, merge ranks and splitting rules of a tokenizer file."""

    def __init__(self, spec: dict) -> None:
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        suffix = model["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or model["ignore_merges"] \
                or [x["type"] for x in pre] != ["Split", "ByteLevel"] or not pre[0]["invert"]:
            raise ValueError("unsupported tokenizer file")
        vocab = model["vocab"]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.piece = pre[0]["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.special = [x["content"] for x in spec["added_tokens"] if not x["normalized"]]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Surviving symbols of each non-empty piece."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out = np.zeros(len(pieces), dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), NONE, dtype=np.int32)
            rank[:-1][inside] = self.pair_ranks(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.concatenate(([True], ~inside)))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            done = lowest == NONE
            out[owner[starts[done]]] = lengths[done]
            live = np.repeat(~done, lengths)
            chosen = (rank == np.repeat(lowest, lengths)) & live
            # of overlapping choices (a a a) every second one, from the left
            at = np.flatnonzero(chosen)
            head = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, dtype=bool)
            run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            live[at + 1] = False
            symbols, owner = symbols[live], owner[live]
        return out


class Counter:
    """Token counts of texts; keeps the counts of at most KEPT_PIECES chunks between them."""

    def __init__(self, merger: PairMerger) -> None:
        self.merger, self.kept = merger, {}
        self.pieces = regex.compile(merger.piece)
        self.chunks = regex.compile(f"[^{_SPACE}]+")
        self.specials = regex.compile("|".join(map(regex.escape, merger.special))) if merger.special else None

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case by character: no final sigma
        text = text.lower()
        return self.chunks.findall(text) if any(c in text for c in _ODD) else text.split()

    def count(self, texts: list[str | None]) -> np.ndarray:
        extra = np.zeros(len(texts), dtype=np.int64)
        lists = []
        for i, text in enumerate(texts):
            text = text or ""
            if self.specials is not None and any(s in text for s in self.merger.special):
                parts = self.specials.split(text)
                extra[i] = len(parts) - 1
                lists.append([c for p in parts for c in self._chunks(p)])
            else:
                lists.append(self._chunks(text))
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        new = list(set().union(*lists) - self.kept.keys())
        for at in range(0, len(new), 50_000):
            self._learn(new[at:at + 50_000])
        get = self.kept.__getitem__
        return extra + np.array([sum(map(get, x)) for x in lists], dtype=np.int64)

    def _learn(self, chunks: list[str]) -> None:
        found = [[p.encode() for p in self.pieces.findall(c)] for c in chunks]
        distinct = list({p for x in found for p in x})
        count = dict(zip(distinct, self.merger.counts(distinct).tolist())) if distinct else {}
        self.kept.update(zip(chunks, (sum(count[p] for p in x) for x in found)))


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit. The file is read on the driver
    and its rules are broadcast (one vocabulary)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(PairMerger(json.load(f)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                n = counter.count(texts)
                size = [0 if t is None else len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n),
                                                  pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
