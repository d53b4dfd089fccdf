"""Texts looked at together give what each gives by itself: tokens, rule pairs, dictionary candidates, marker sentences."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

from skillweave.operators import annotate

PARTS = ["gute", "schöne", "Berufliche", "Leitung", "KEITen", "Keit", "KKEIT", "lİch", "ISCH", "ig", " ", "  ", "\n", ".",
         "!?", "\0", "ΑΣ", "Σ.", "\U0001d518x", "漢字", "12", "Ⅷ", "\x85", "　", "á", "ung", "tion", "barem", "bar",
         "\t", ",", "not", "paſ", "NICHT", "schaften", ".", " ", " "]


def _texts(rnd):
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 3, 10, 40]))) for _ in range(rnd.choice([1, 2, 7]))]


def test_token_columns_are_the_tokens_of_each_text():
    rnd = random.Random(1)
    for _ in range(300):
        texts = _texts(rnd)
        out = annotate.token_columns(pa.array([f"p{i}" for i in range(len(texts))]), texts)
        out.validate(full=True)
        assert [tuple(r.values()) for r in out.to_pylist()] == [
            (f"p{i}", *row) for i, text in enumerate(texts) for row in annotate._tokens(text)]


def _pairs(text):
    tokens = annotate._tokens(text)
    spans = [(t[6], tokens[t[5]][7]) for t in tokens if t[4] == "nk"]
    return [{"char_start": a, "char_end": b, "text": text[a:b]} for a, b in spans]


def _grams(text, sizes, bitmap):
    words = [(m.group(), *m.span()) for m in annotate.WORD.finditer(text)]
    bare = [w.rstrip(annotate.TRAILING_PUNCT).lower() for w, _, _ in words]
    out = []
    for n in sizes:
        for i in range(len(words) - n + 1):
            h = np.array([42], dtype=np.uint64)
            for w in bare[i:i + n]:
                h = annotate._mixed(np.array([xxhash.xxh64_intdigest(w, 42)], dtype=np.uint64), h)
            if annotate.in_bitmap(bitmap, h)[0]:
                out.append({"n": n, "key": " ".join(bare[i:i + n]), "words": [
                    {"w": j, "word": words[j][0], "start": words[j][1], "end": words[j][2]} for j in range(i, i + n)]})
    return out


def _marked(text, markers):
    has = regex.compile("|".join(map(regex.escape, markers)), regex.IGNORECASE) if markers else None
    return [{"char_start": m.start(), "char_end": m.end()} for m in annotate.SENTENCE.finditer(text)
            if has is not None and has.search(m.group())]


@pytest.mark.parametrize("markers", [("nicht", "auch", "not", "pas"), (), ("g\0", "t. "), ("e.", "\0")])
def test_scan_of_joined_texts_is_the_scan_of_each(markers):
    rnd = random.Random(2)
    bits = np.frombuffer(rnd.randbytes(1 << 10), dtype=np.uint8)
    scanner = annotate.Scanner([1, 3, 5], bits, markers)
    for _ in range(40):
        texts = _texts(rnd)
        out = scanner.scan(pa.array([f"p{i}" for i in range(len(texts))]), texts)
        out.validate(full=True)
        for text, got in zip(texts, out.to_pylist()):
            assert got["pairs"] == _pairs(text)
            assert got["grams"] == _grams(text, [1, 3, 5], bits)
            assert got["marked"] == _marked(text, markers)
            assert got["n_tokens"] == len(annotate._tokens(text))
            assert got["n_sentences"] == len(annotate.SENTENCE.findall(text))


def test_a_word_is_hashed_once_for_all_texts_of_a_portion():
    class Counted(annotate._WordHashes):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)
    scanner = annotate.Scanner([3], np.zeros(1 << 10, dtype=np.uint8), ())
    scanner.hashes = Counted()
    scanner.scan(pa.array(["a", "b"]), ["eins zwei drei " * 500, "zwei vier " * 500])
    assert Counted.asked == 4


def test_portions_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(annotate, "JOINED_CHARS", 10)
    texts = ["abc", None, "x" * 30, "", "defg", "hijkl", "mno"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(7)]), pa.array(texts)], names=["id", "raw_text"])
    got = [(ids.to_pylist(), held) for ids, held in annotate._portions_of(batch)]
    assert [k for ids, _ in got for k in ids] == list("0123456")
    assert [t for _, held in got for t in held] == [t or "" for t in texts]
    assert all(len(held) == 1 or sum(map(len, held)) <= 10 for _, held in got)


def test_hashes_of_many_words_are_those_of_each():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcXYZ019.,;:!?)(-" if rnd.random() < 0.8 else "äÖßΣİ漢\U0001d518\0'") for _ in range(rnd.randrange(50)))
             for _ in range(5_000)] + ["A" * n + "." for n in range(70)]
    got = annotate._WordHashes().of(pa.array(words).slice(7))
    assert got.tolist() == [xxhash.xxh64_intdigest(w.rstrip(annotate.TRAILING_PUNCT).lower(), 42) for w in words[7:]]


def test_words_of_ascii_letters_are_not_hashed_one_by_one():
    class Counted(annotate._WordHashes):
        asked = []

        def __missing__(self, word):
            Counted.asked.append(word)
            return super().__missing__(word)
    scanner = annotate.Scanner([3], np.zeros(1 << 10, dtype=np.uint8), ())
    scanner.hashes = Counted()
    scanner.scan(pa.array(["a"]), [" ".join(f"Wort{i}, schön{i % 3}" for i in range(1_000))])
    assert sorted(Counted.asked) == ["schön0", "schön1", "schön2"]


@pytest.mark.parametrize("extra", ["", "\u0130", "\u0131", "\u017f", "\u212a", "ΑΣ", "\U0001d518"])
def test_places_of_plain_markers_are_those_of_the_expression(extra):
    rnd = random.Random(6)
    markers = ("nicht", "Auch", "sk 1", "not", "pas")
    scanner = annotate.Scanner([3], np.zeros(1 << 10, dtype=np.uint8), markers)
    parts = ["NICHT", "auch", "SK 1", "\u212a", "no", "Not", "pa", "s", "pas", "\u017f", " ", "é", extra]
    for _ in range(200):
        text = "".join(rnd.choice(parts if extra else parts[:3] + parts[4:9]) for _ in range(20)) + extra
        got = scanner.marker_places(text)
        assert sorted(got) == sorted({m.start() for m in scanner.marker.finditer(text, overlapped=True)}) or any(
            c in text for c in annotate.OTHER_CASES) and got == [m.start() for m in scanner.marker.finditer(text)]
