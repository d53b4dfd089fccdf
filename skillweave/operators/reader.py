"""A text model's slot: tokens and sentences of an advert from one reading.

``load()`` runs once in a task and gives ``read(text) -> (tokens, sentences)``: tokens as (i, text, pos, lemma, dep,
head_i, char_start, char_end), sentences as (char_start, char_end). Both come from one Arrow pass over the texts where
they lie, so the model sees each text once and the sentences are the model's own. ``read_parts`` gives every token and
sentence; ``read_spots`` only what spans are made of, so that words of other kinds never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.functions.text import has_marker
from skillweave.operators.annotate import _rows

_PARTS = pa.schema([("posting_id", pa.string()), ("part", pa.string()), ("i", pa.int64()), ("text", pa.string()),
                    ("pos", pa.string()), ("lemma", pa.string()), ("dep", pa.string()), ("head_i", pa.int64()),
                    ("char_start", pa.int64()), ("char_end", pa.int64())])
_SCHEMA = ("posting_id string, part string, i long, text string, pos string, lemma string, dep string, head_i long, "
           "char_start long, char_end long")


class _Reading:
    """The rows of a text; the model is loaded by the first text of a task."""

    def __init__(self, load: Callable, pairs_only: bool = False) -> None:
        self.load, self.pairs_only, self.read = load, pairs_only, None

    def __call__(self, text: str) -> Iterator[tuple]:
        if self.read is None:
            self.read = self.load()
        tokens, sentences = self.read(text)
        for token in tokens:
            if not self.pairs_only:
                yield ("token", *token)
            elif token[2] in ("NOUN", "PROPN") or token[2] == "ADJ" and token[4] in ("nk", "amod"):
                yield ("token", token[0], None, token[2], None, *token[4:])
        for i, (start, end) in enumerate(sentences):
            yield ("sentence", i, text[start:end], None, None, None, None, start, end)


def read_parts(postings: DataFrame, load: Callable, key: str = "id", text_col: str = "raw_text") -> DataFrame:
    """(posting_id, part, i, text, pos, lemma, dep, head_i, char_start, char_end) with part ``token`` or ``sentence``;
    null texts have none."""
    return _rows(postings, key, text_col, _SCHEMA, _PARTS, _Reading(load), empty=True)


def read_spots(postings: DataFrame, load: Callable, markers, key: str = "id", text_col: str = "raw_text") -> DataFrame:
    """The tokens that a pair of adjective and head may have, without their texts, and the sentences with a marker:
    (posting_id, part, i, pos, dep, head_i, char_start, char_end)."""
    rows = _rows(postings, key, text_col, _SCHEMA, _PARTS, _Reading(load, pairs_only=True), empty=True)
    return rows.where((F.col("part") == "token") | has_marker("text", markers)).drop("text", "lemma")


def tokens_of(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'token'").drop("part")


def sentences_of(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'sentence'").select("posting_id", F.col("i").alias("sent_ord"), "char_start", "char_end", "text")
