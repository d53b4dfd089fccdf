"""Text annotation: tokenizer, suffix-rule annotator, sentence splitter, and the scan for span candidates.

A text is cut where it lies: one Arrow pass per advert yields pieces with code-point offsets, so no text is shuffled
and nothing is sorted per token. ``tokens``, ``sentences`` and ``words`` give every piece as a row; ``scan`` gives
only what the extractors need (adjective + noun pairs, dictionary n-gram candidates, marker sentences), with the
slices of the text cut on the spot.

The annotator is the default of a model slot: a real tagger/parser can supply a table with the token columns (see
``annotator_slot``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.config import TRAILING_PUNCT
from skillweave.functions.bitmaps import in_bitmap

_WS = r" \t\n\x0b\f\r"
# Words, single punctuation marks, whitespace runs. Together they cover every char.
TOKEN = regex.compile(rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{_WS}]|[{_WS}]+")
# Text up to and including sentence terminators, or a trailing piece without one.
SENTENCE = regex.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
# Whitespace-delimited words (tagger input).
WORD = regex.compile(rf"[^{_WS}]+")
# Blanks that ``str.split`` takes for such and WORD does not.
OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
NUMBER = regex.compile(r"\p{N}+")
LETTER = regex.compile(r"[\p{L}\p{N}]")
# Markers that match what their lower case is in a lower-cased text, but for ``OTHER_CASES``: further cases of i, k and s.
PLAIN_MARKER = re.compile("[A-Za-z0-9 ]+")
OTHER_CASES = "\u0130\u0131\u017f\u212a"

# Suffix rules of the default annotator (lower-cased word).
_ADJ = tuple(s + e for s in ("lich", "isch", "ig", "bar", "sam") for e in ("", "e", "er", "en", "es", "em"))
_NOUN = tuple(s + e for s in ("ung", "heit", "keit", "schaft", "tion") for e in ("", "en"))
_ADJ_LEMMA = regex.compile(r"(lich|isch|ig|bar|sam)(e|er|en|es|em)$")
_NOUN_LEMMA = regex.compile(r"(ung|heit|keit|schaft|tion)en$")

TOKEN_COLUMNS = ["posting_id", "i", "text", "pos", "lemma", "dep", "head_i", "char_start", "char_end"]
#: Rows handed on at a time.
BATCH_ROWS = 20_000
#: Words that a task's tables keep.
KEPT_WORDS = 500_000
#: Fewer words are hashed one by one.
FEW_WORDS = 64


def _rows(df: DataFrame, key: str, text_col: str, schema: str, fields: pa.Schema, make: Callable,
          empty: bool = False) -> DataFrame:
    """Rows of ``make(text)`` for each text, with the key in front; null texts give none, nor do empty ones unless
    ``make`` is to see them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), fields)], schema=fields)
        for batch in batches:
            for pid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for row in make(text) if text or empty and text is not None else ():
                    held.append((pid, *row))
                    if len(held) >= BATCH_ROWS:
                        yield out()
                        held = []
        if held:
            yield out()
    return df.select(F.col(key).cast("string"), F.col(text_col)).mapInArrow(run, schema)


def _kind(word: str, low: str) -> str:
    if NUMBER.fullmatch(word):
        return "NUM"
    return "NOUN" if low.endswith(_NOUN) else "ADJ" if low.endswith(_ADJ) else "X"


class _Pieces(dict):
    """What a piece of text is by itself: (pos, lemma, whether a sentence ends at it); pos is None for whitespace."""

    def __missing__(self, piece: str) -> tuple:
        if len(self) > KEPT_WORDS:
            self.clear()
        if piece[0] in " \t\n\x0b\f\r":
            out = (None, None, "\n" in piece)
        else:
            low = piece.lower()
            pos = _kind(piece, low) if LETTER.match(piece) else "PUNCT"
            lemma = (piece if pos in ("PUNCT", "NUM") else _ADJ_LEMMA.sub(r"\1", low) if pos == "ADJ"
                     else _NOUN_LEMMA.sub(r"\1", low) if pos == "NOUN" else low)
            out = (pos, lemma, piece in ".!?")
        self[piece] = out
        return out


_PIECES = _Pieces()


def _tokens(text: str) -> list[tuple]:
    """i, text, pos, lemma, dep, head_i, char_start, char_end; an adjective's head is the next noun of its sentence."""
    out, i, start, headless = [], 0, 0, []
    for piece in TOKEN.findall(text):  # the pieces cover the text
        end = start + len(piece)
        pos, lemma, ends = _PIECES[piece]
        if pos is not None:
            if pos == "NOUN":
                for a in headless:
                    out[a] = (*out[a][:4], "nk", i, *out[a][6:])
                headless = []
            elif pos == "ADJ":
                headless.append(i)
            out.append((i, piece, pos, lemma, "ROOT", i, start, end))
            i += 1
        if ends:
            headless = []
        start = end
    return out


_TOKENS = pa.schema([("posting_id", pa.string()), ("i", pa.int64()), ("text", pa.string()), ("pos", pa.string()),
                     ("lemma", pa.string()), ("dep", pa.string()), ("head_i", pa.int64()), ("char_start", pa.int64()),
                     ("char_end", pa.int64())])


def token_columns(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """What ``_tokens`` finds in each text, as columns; only distinct pieces are looked at one by one."""
    joined = Joined(texts)
    mark = (joined.kind & (_LETTER | _SPACE)) == 0
    word = (joined.kind & _LETTER) != 0
    start = np.flatnonzero(mark | (word & ~np.append(False, word[:-1])))
    end = np.flatnonzero(mark | (word & ~np.append(word[1:], False))) + 1
    owner = joined.owner(start)
    i = np.arange(len(start)) - np.searchsorted(owner, np.arange(len(texts)))[owner]
    text = joined.pieces(start, end)
    coded = text.dictionary_encode()
    known = [_PIECES[x] for x in coded.dictionary.to_pylist()]
    pos, lemma = (pa.array([x[j] for x in known], pa.string()).take(coded.indices) for j in (0, 1))
    kind = np.array([{"ADJ": ADJ, "NOUN": NOUN}.get(x[0], 0) for x in known], dtype=np.int8)[coded.indices.to_numpy()]
    adj, head = joined.heads(start, np.flatnonzero(kind == ADJ), np.flatnonzero(kind == NOUN))
    head_i, nk = i.copy(), np.zeros(len(i), dtype=np.int8)
    head_i[adj], nk[adj] = i[head], 1
    dep = pa.array(["ROOT", "nk"]).take(pa.array(nk))
    shift = joined.start[owner]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(i), text, pos, lemma, dep, pa.array(head_i),
                                       pa.array(start - shift), pa.array(end - shift)], schema=_TOKENS)


def tokens(postings: DataFrame, key: str = "posting_id", text_col: str = "raw_text") -> DataFrame:
    """Token table of the default annotator; whitespace is dropped, i counts the kept tokens from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _portions_of(batch):
                out = token_columns(ids, texts)
                for at in range(0, out.num_rows, BATCH_ROWS):
                    yield out.slice(at, BATCH_ROWS)
    return postings.select(F.col(key).cast("string"), F.col(text_col)).mapInArrow(
        run, "posting_id string, i long, text string, pos string, lemma string, dep string, head_i long, char_start long, "
             "char_end long")


def sentences(postings: DataFrame, key: str = "posting_id", text_col: str = "raw_text") -> DataFrame:
    """Sentence pieces covering each text: (posting_id, sent_ord, char_start, char_end, text)."""
    return _rows(postings, key, text_col, "posting_id string, sent_ord long, char_start long, char_end long, text string",
                 pa.schema([("posting_id", pa.string()), ("sent_ord", pa.int64()), ("char_start", pa.int64()),
                            ("char_end", pa.int64()), ("text", pa.string())]),
                 lambda text: ((i, m.start(), m.end(), m.group()) for i, m in enumerate(SENTENCE.finditer(text))))


def words(postings: DataFrame, key: str = "posting_id", text_col: str = "raw_text") -> DataFrame:
    """Whitespace-delimited words with offsets and word index w (tagger input)."""
    return _rows(postings, key, text_col, "posting_id string, w long, word string, char_start long, char_end long",
                 pa.schema([("posting_id", pa.string()), ("w", pa.int64()), ("word", pa.string()),
                            ("char_start", pa.int64()), ("char_end", pa.int64())]),
                 lambda text: ((w, m.group(), m.start(), m.end()) for w, m in enumerate(WORD.finditer(text))))


# ---- candidates only -------------------------------------------------------------------------------------------
# A text is classed by code points in numpy; words are looked at one by one only where a table of the task, keyed by the
# word, has not seen them.

_LETTER, _SPACE, _END = 1, 2, 4
ADJ, NOUN, END = 1, 2, 3
_P1, _P2, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_P3 = np.uint64(0x165667B19E3779F9)


@cache
def _classes() -> np.ndarray:
    """Class of each code point below 2**16."""
    out = np.array([_LETTER * (LETTER.match(chr(c)) is not None) for c in range(1 << 16)], dtype=np.uint8)
    out[list(b" \t\n\x0b\f\r")] |= _SPACE
    out[list(b".!?\n")] |= _END
    return out


class Joined:
    """Texts one after another, a separator behind each, with the places of what is in them, in code points.

    The separators are blanks that end no sentence, so nothing that is found reaches from one text into the next."""

    def __init__(self, texts: list[str]) -> None:
        self.text = "\0".join([*texts, ""])
        self.length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.stop = np.cumsum(self.length + 1) - 1
        self.start = self.stop - self.length
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.kind = _classes()[np.minimum(self.points, 0xFFFF)]
        for c in np.unique(self.points[self.points > 0xFFFF]).tolist():
            self.kind[self.points == c] = _LETTER * (LETTER.match(chr(c)) is not None)
        self.kind[self.stop] = _SPACE

    def owner(self, place: np.ndarray) -> np.ndarray:
        """The number of the text that holds each place."""
        return np.searchsorted(self.stop, place)

    def counted(self, place: np.ndarray) -> np.ndarray:
        """How many of the places, in order, each text holds."""
        return np.diff(np.searchsorted(place, self.stop), prepend=0)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of runs of letters and digits."""
        return _runs((self.kind & _LETTER) != 0)

    @property
    def n_tokens(self) -> np.ndarray:
        marks = np.flatnonzero((self.kind & (_LETTER | _SPACE)) == 0)
        return self.counted(self.words[0]) + self.counted(marks)

    @cached_property
    def sentence_end(self) -> np.ndarray:
        """Where each sentence ends: after a run of ending marks, and with a text."""
        end = (self.kind & _END) != 0
        open_ = (self.length > 0) & ~end[self.stop - 1]
        out = np.flatnonzero(end[:-1] & ~end[1:]) + 1
        return np.sort(np.concatenate([out, self.stop[open_]]))

    @cached_property
    def breaks(self) -> np.ndarray:
        """Ending marks and separators: no pair reaches over them."""
        broken = (self.kind & _END) != 0
        broken[self.stop] = True
        return np.flatnonzero(broken)

    def heads(self, start: np.ndarray, adj: np.ndarray, nouns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(adjective, head) of the adjectives that have one, as numbers in ``start``: the next noun of the sentence."""
        if not len(adj) or not len(nouns):
            return adj[:0], nouns[:0]
        next_ = np.searchsorted(nouns, adj)
        adj, head = adj[next_ < len(nouns)], nouns[next_[next_ < len(nouns)]]
        inside = start[head] < self.breaks[np.searchsorted(self.breaks, start[adj])]
        return adj[inside], head[inside]

    def pieces(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The slices from ``start`` to ``end``, in order and disjoint, as an array of strings."""
        size = (1 + (self.points > 0x7F) + (self.points > 0x7FF) + (self.points > 0xFFFF)).astype(np.int32)
        at = np.concatenate(([0], np.cumsum(size)))
        keep = np.zeros(len(self.points) + 1, dtype=np.int8)
        keep[start] += 1
        keep[end] -= 1
        keep = np.repeat(np.cumsum(keep[:-1], dtype=np.int8), size) > 0
        data = np.frombuffer(self.text.encode("utf-8", "surrogatepass"), dtype=np.uint8)[keep]
        offsets = np.concatenate(([0], np.cumsum(at[end] - at[start]))).astype(np.int32)
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of true values."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Characters of the texts that are looked at together; a longer text is looked at by itself.
JOINED_CHARS = 1 << 18


def _portions_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """(keys, texts) of a batch of keys and texts, some ``JOINED_CHARS`` at a time; null texts are empty."""
    keys, texts = batch.column(0).cast(pa.string()), batch.column(1)
    held, size, first = [], 0, 0
    for at in range(batch.num_rows):
        text = texts[at].as_py() or ""
        if held and size + len(text) > JOINED_CHARS:
            yield keys.slice(first, len(held)), held
            held, size, first = [], 0, at
        held.append(text)
        size += len(text)
    if held:
        yield keys.slice(first, len(held)), held


def word_list(text: str) -> list[str]:
    """What WORD finds."""
    return WORD.findall(text) if OTHER_BLANK.search(text) else text.split()


def _in_words(points: np.ndarray) -> np.ndarray:
    return (points != 32) & ((points < 9) | (points > 13))


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of what WORD finds."""
    return _runs(_in_words(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)))


def piece_counts(text: str) -> tuple[int, int]:
    """How many tokens and sentences a text has, without cutting it."""
    joined = Joined([text])
    return int(joined.n_tokens[0]), len(joined.sentence_end)


@cache
def _letters() -> np.ndarray:
    """1 to 26 for each code point below 2**16 whose lower case is a letter from a to z, otherwise 0."""
    out = np.zeros(1 << 16, dtype=np.int64)
    for c in range(1 << 16):
        low = chr(c).lower()
        if len(low) == 1 and "a" <= low <= "z":
            out[c] = ord(low) - 96
    return out


def _ends_like(tails: np.ndarray, suffixes: tuple[str, ...]) -> np.ndarray:
    """Which of the words whose last letters are coded in ``tails`` end in one of the suffixes."""
    out = np.zeros(len(tails), dtype=bool)
    for s in suffixes:
        code = sum((ord(c) - 96) << (5 * j) for j, c in enumerate(reversed(s)))
        out |= (tails & ((1 << (5 * len(s))) - 1)) == code
    return out


def word_kinds(points: np.ndarray, end: np.ndarray) -> np.ndarray:
    """ADJ, NOUN or 0 for each word that ends at ``end``, as ``_kind`` has it; something else stands before each word."""
    letters = _letters()
    tails = np.zeros(len(end), dtype=np.int64)
    for j in range(max(map(len, (*_ADJ, *_NOUN)))):
        at = np.maximum(end - 1 - j, 0)
        code = letters[np.minimum(points[at], 0xFFFF)]
        tails |= np.where(end - 1 - j >= 0, code, 0) << (5 * j)
    return np.where(_ends_like(tails, _NOUN), NOUN, np.where(_ends_like(tails, _ADJ), ADJ, 0))


class _WordHashes(dict):
    """Hash of a word as the dictionary has it: no punctuation at its end, lower case."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.rstrip(TRAILING_PUNCT).lower(), 42)
        self[word] = h
        return h

    def of(self, words: pa.StringArray) -> np.ndarray:
        """The hashes of words; unless they are few, only long ones and those beyond ASCII are looked at one by one."""
        if len(words) < FEW_WORDS:
            return np.fromiter(map(self.__getitem__, words.to_pylist()), dtype=np.uint64, count=len(words))
        bare = pc.ascii_lower(pc.ascii_rtrim(words, TRAILING_PUNCT))
        at = np.frombuffer(bare.buffers()[1], dtype=np.int32)[bare.offset:bare.offset + len(bare) + 1].astype(np.int64)
        held = bare.buffers()[2]
        data = np.zeros(at[-1] + 8, dtype=np.uint8)
        if held is not None:
            data[:at[-1]] = np.frombuffer(held, dtype=np.uint8)[:at[-1]]
        size = np.diff(at)
        high = np.flatnonzero(data > 0x7F)
        plain = (size < 32) & (np.searchsorted(high, at[:-1]) == np.searchsorted(high, at[1:]))
        out = np.empty(len(words), dtype=np.uint64)
        out[plain] = _hashed(data, at[:-1][plain], size[plain])
        rest = np.flatnonzero(~plain)
        out[rest] = np.fromiter(map(self.__getitem__, words.take(pa.array(rest)).to_pylist()), dtype=np.uint64, count=len(rest))
        return out


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _settled(h: np.ndarray) -> np.ndarray:
    """The last step of xxHash64."""
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxHash64, seed 42, of slices of less than 32 bytes; eight bytes more stand behind the last one."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    four = np.ndarray(len(data) - 3, dtype="<u4", buffer=data, strides=(1,))
    h = size.astype(np.uint64) + (_P5 + np.uint64(42))
    for at in range(0, 24, 8):
        i = np.flatnonzero(size >= at + 8)
        h[i] = _rotated(h[i] ^ (_rotated(eight[start[i] + at] * _P2, 31) * _P1), 27) * _P1 + _P4
    at, left = start + (size & ~7), size & 7
    i = np.flatnonzero(left >= 4)
    h[i] = _rotated(h[i] ^ (four[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at, left = start + (size & ~3), size & 3
    for j in range(3):
        i = np.flatnonzero(left > j)
        h[i] = _rotated(h[i] ^ (data[at[i] + j].astype(np.uint64) * _P5), 11) * _P1
    return _settled(h)


def _mixed(words: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash64 of 64-bit values with a seed each, as Spark's xxhash64 takes the elements of an array."""
    h = (seed + _P5 + np.uint64(8)) ^ (_rotated(words * _P2, 31) * _P1)
    return _settled(_rotated(h, 27) * _P1 + _P4)


def gram_hash(key):
    """The hash of a dictionary key (words joined by blanks) that the scan looks for, as an expression."""
    return F.xxhash64(F.transform(F.split(key, " "), lambda w: F.xxhash64(w)))


class Scanner:
    """What a task keeps between texts, and the scan of one text."""

    def __init__(self, sizes: list[int], bitmap: np.ndarray, markers) -> None:
        self.sizes, self.bitmap = sizes, bitmap
        self.marker = regex.compile("|".join(map(regex.escape, markers)), regex.IGNORECASE) if markers else None
        # a marker with an ending mark (or a separator) in it may lie across sentences; these are then searched one by one
        self.one_by_one = bool(markers) and any(c in m for m in markers for c in ".!?\n\0")
        # markers of these letters alone are searched in the lower-cased text, where that has the same places
        self.plain = [m.lower() for m in markers] if all(PLAIN_MARKER.fullmatch(m) for m in markers) else []
        self.hashes = _WordHashes()

    def scan(self, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        """What the extractors need of each text."""
        if len(self.hashes) > KEPT_WORDS:
            self.hashes.clear()
        joined = Joined(texts)
        return pa.RecordBatch.from_arrays(
            [ids, self.pairs(joined), self.grams(joined), self.marked(joined), pa.array(joined.n_tokens),
             pa.array(joined.counted(joined.sentence_end - 1))], schema=_SCAN)

    def pairs(self, joined: Joined) -> pa.Array:
        """Adjective + head slices of the default annotator, in text order: the head is the next noun of the sentence."""
        start, end = joined.words
        kind = word_kinds(joined.points, end)
        adj, head = joined.heads(start, np.flatnonzero(kind == ADJ), np.flatnonzero(kind == NOUN))
        first, last = start[adj], end[head]
        text = pa.array([joined.text[a:b] for a, b in zip(first.tolist(), last.tolist())], pa.string())
        shift = joined.start[joined.owner(first)]
        return _lists(joined.counted(first), [first - shift, last - shift, text], _SCAN.field("pairs").type)

    def grams(self, joined: Joined) -> pa.Array:
        """n-grams of normalised words that may be in the dictionary, with the words they cover; by size, then place."""
        inside = _in_words(joined.points)
        inside[joined.stop] = False
        start, end = _runs(inside)
        coded = joined.pieces(start, end).dictionary_encode()
        code = coded.indices.to_numpy()
        own, owner = self.hashes.of(coded.dictionary)[code], joined.owner(start)
        h, mixed, found = np.full(len(own), 42, dtype=np.uint64), 0, []
        for n in self.sizes:  # a longer gram goes on from the shorter one that it begins with
            if len(own) < n:
                break
            while mixed < n:
                h = _mixed(own[mixed:], h[:len(own) - mixed])
                mixed += 1
            at = np.flatnonzero(in_bitmap(self.bitmap, h) & (owner[:len(h)] == owner[n - 1:]))
            found.append((np.full(len(at), n), at))
        n, at = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((at, n, owner[at]))
        n, at = n[order], at[order]
        cover = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
        said = coded.dictionary.take(pa.array(code[cover])).to_pylist()
        bare = [w.rstrip(TRAILING_PUNCT).lower() for w in said]
        bounds = np.concatenate(([0], np.cumsum(n))).tolist()
        key = pa.array([" ".join(bare[a:b]) for a, b in zip(bounds, bounds[1:])], pa.string())
        mine = owner[cover]
        w = cover - np.searchsorted(owner, mine)
        shift = joined.start[mine]
        kind = _SCAN.field("grams").type
        words = _lists(n, [w, pa.array(said, pa.string()), start[cover] - shift, end[cover] - shift],
                       kind.value_type.field("words").type)
        return _lists(np.bincount(owner[at], minlength=len(joined.stop)), [n.astype(np.int32), key, words], kind)

    def marker_places(self, text: str) -> list[int]:
        """Where markers begin; of such as overlap, which lie in one sentence, the first may stand for all."""
        low = text.lower() if self.plain and not any(c in text for c in OTHER_CASES) else ""
        if len(low) != len(text):
            return [m.start() for m in self.marker.finditer(text)]
        out = []
        for marker in self.plain:
            at = low.find(marker)
            while at >= 0:
                out.append(at)
                at = low.find(marker, at + 1)
        return out

    def marked(self, joined: Joined) -> pa.Array:
        """Sentences that hold a marker."""
        ends = joined.sentence_end
        owner = joined.owner(ends - 1)
        starts = np.maximum(np.append(0, ends[:-1])[:len(ends)], joined.start[owner])
        if self.marker is None:
            found = np.zeros(0, dtype=np.int64)
        elif self.one_by_one:
            found = np.array([i for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist()))
                              if self.marker.search(joined.text, a, b)], dtype=np.int64)
        else:
            at = np.array(self.marker_places(joined.text), dtype=np.int64)
            found = np.unique(np.searchsorted(ends, at, side="right"))
        shift = joined.start[owner[found]]
        return _lists(np.bincount(owner[found], minlength=len(joined.stop)), [starts[found] - shift, ends[found] - shift],
                      _SCAN.field("marked").type)


def _lists(counts: np.ndarray, columns: list, kind: pa.DataType) -> pa.Array:
    """Lists of structs: so many for each row, one after another in ``columns``."""
    fields = list(kind.value_type)
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)]
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, fields=fields), type=kind)


_SPOT = "struct<char_start:long,char_end:long>"
SCAN_SCHEMA = ("posting_id string, pairs array<struct<char_start:long,char_end:long,text:string>>, "
               "grams array<struct<n:int,key:string,words:array<struct<w:long,word:string,start:long,end:long>>>>, "
               f"marked array<{_SPOT}>, n_tokens long, n_sentences long")
_SCAN = pa.schema([
    ("posting_id", pa.string()),
    ("pairs", pa.list_(pa.struct([("char_start", pa.int64()), ("char_end", pa.int64()), ("text", pa.string())]))),
    ("grams", pa.list_(pa.struct([("n", pa.int32()), ("key", pa.string()), ("words", pa.list_(pa.struct([
        ("w", pa.int64()), ("word", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]))),
    ("marked", pa.list_(pa.struct([("char_start", pa.int64()), ("char_end", pa.int64())]))),
    ("n_tokens", pa.int64()), ("n_sentences", pa.int64())])


def scan(postings: DataFrame, sizes: list[int], bitmap: np.ndarray, markers, key: str = "id",
         text_col: str = "raw_text") -> DataFrame:
    """One row per advert: rule pairs, dictionary candidates (``sizes`` words; ``bitmap`` of the dictionary's key
    hashes), marker sentences, and the numbers of tokens and sentences. Everything the extractors need, in one pass over the text where it lies."""
    shared = postings.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sizes, shared.value, markers)
        for batch in batches:
            for ids, texts in _portions_of(batch):
                yield scanner.scan(ids, texts)
    return postings.select(F.col(key).cast("string").alias("posting_id"), F.col(text_col)).mapInArrow(run, SCAN_SCHEMA)


def annotator_slot(postings: DataFrame, annotate_batch, key: str = "posting_id",
                   text_col: str = "raw_text") -> DataFrame:
    """Run a model annotator over the postings with ``mapInPandas``.

    ``annotate_batch(pdf) -> pdf`` receives (posting_id, raw_text) batches and
    returns rows with ``TOKEN_COLUMNS``; the model is loaded once per Python
    worker by the callable itself. Columns are pruned before the slot, as
    Catalyst cannot push anything through it.
    """
    schema = ("posting_id string, i long, text string, pos string, lemma string, dep string, "
              "head_i long, char_start long, char_end long")

    def run(batches):
        for pdf in batches:
            yield annotate_batch(pdf)

    return postings.select(F.col(key).alias("posting_id"), F.col(text_col).alias("raw_text")).mapInPandas(
        run, schema)
