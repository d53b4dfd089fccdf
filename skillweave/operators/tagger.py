"""Dictionary tagger (default of the token-classification slot) and hit merging.

A tagger pass per model yields word-level hits (posting_id, model, hit_ord,
word, start, end, score). Hits are post-processed exactly like the model
output of the original pipeline: trailing punctuation is stripped (the end
offset moves with it), empty words dropped, and hits whose gap to the
previous hit's end is at most one character are merged into one span whose
text is the words joined by a blank and whose score is the running pairwise
average ``(prev + next) / 2``.

The text is cut into words where it lies; only n-grams whose hash is in a fixed-size bitmap of the dictionary's keys
become rows, and one inner join on (n, key) keeps the true ones. Words without a match are never shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.config import TRAILING_PUNCT
from skillweave.functions.text import strip_trailing
from skillweave.functions.bitmaps import slot_bitmap
from skillweave.operators import annotate
from skillweave.operators.annotate import words as word_table

#: The bitmap of dictionary keys takes 2**KEY_BITS / 8 bytes (1 MB) at any size of the dictionary.
KEY_BITS = 23

HIT_COLUMNS = ["posting_id", "model", "hit_ord", "word", "start", "end", "score"]


def _norm(word_col) -> F.Column:
    return F.lower(strip_trailing(word_col))


def _gram_key(n: int) -> F.Column:
    """Normalised n-gram starting at the current word (null past the end)."""
    parts = [F.col("norm")]
    for j in range(1, n):
        parts += [F.lit(" "), F.col(f"l{j}_")]
    return F.concat(*parts)


def _with_leads(words_df: DataFrame, max_n: int) -> DataFrame:
    w = Window.partitionBy("posting_id").orderBy("w")
    base = words_df.withColumn("norm", _norm("word"))
    for j in range(1, max_n):
        base = base.withColumn(f"l{j}_", F.lead("norm", j).over(w))
    return base


def gram_dictionary(texts: DataFrame, n: int, model: str, key: str = "item_id",
                    text_col: str = "text") -> DataFrame:
    """All word n-grams of reference texts; weight = 1 / number of texts holding it."""
    wt = word_table(texts.select(F.col(key).cast("string").alias("posting_id"), F.col(text_col).alias("raw_text")))
    grams = _with_leads(wt, n).select("posting_id", _gram_key(n).alias("key")).filter(F.col("key").isNotNull())
    return (grams.groupBy("key").agg(F.countDistinct("posting_id").alias("n_items"))
            .select(F.lit(model).alias("model"), F.lit(n).cast("int").alias("n"), "key",
                    (F.lit(1.0) / F.col("n_items")).alias("weight")))


def label_dictionary(concepts: DataFrame, model: str = "skill", weight: float = 1.0) -> DataFrame:
    """Dictionary of concept labels (preferred and alternative), one n-gram each."""
    labels = concepts.select(F.explode(F.array_union(F.array("pref_label"),
                                                      F.coalesce("alt_labels", F.array().cast("array<string>")))
                                       ).alias("label"))
    toks = F.filter(F.split(F.trim("label"), r"\s+"), lambda x: x != "")
    keyed = labels.select(F.transform(toks, lambda x: F.lower(F.rtrim(x, F.lit(TRAILING_PUNCT)))).alias("t"))
    return (keyed.filter(F.size("t") > 0)
            .select(F.lit(model).alias("model"), F.size("t").cast("int").alias("n"),
                    F.array_join("t", " ").alias("key"), F.lit(weight).alias("weight"))
            .dropDuplicates(["model", "n", "key"]))


def dictionary_sizes(dictionary: DataFrame) -> list[tuple[str, int]]:
    """The (model, n) pairs of a dictionary: a handful of rows from a small side table."""
    return sorted((r["model"], int(r["n"])) for r in dictionary.select("model", "n").distinct().collect())


def key_bitmap(dictionary: DataFrame):
    """Bitmap of the hashes of all dictionary keys."""
    return slot_bitmap(dictionary.select(annotate.gram_hash(F.col("key")).alias("h")), "h", KEY_BITS)


def dictionary_hits(postings: DataFrame, dictionary: DataFrame, pairs: list[tuple[str, int]],
                    key: str = "posting_id", text_col: str = "raw_text") -> DataFrame:
    """Raw word-level hits: every word covered by a dictionary n-gram occurrence, one per (posting, model, word)."""
    scanned = annotate.scan(postings, sorted({n for _, n in pairs}), key_bitmap(dictionary), (), key, text_col)
    return hits_of(scanned.select("posting_id", F.explode("grams").alias("g")), dictionary)


def hits_of(grams: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Hits of candidate n-grams (posting_id, g) that are in the dictionary; score = highest weight of the covering
    occurrences. Only matched occurrences reach the aggregation."""
    found = (grams.select("posting_id", "g.n", "g.key", "g.words")
             .join(dictionary.select("model", "n", "key", "weight"), ["n", "key"])
             .select("posting_id", "model", "weight", F.explode("words").alias("x")))
    return (found.groupBy("posting_id", "model", F.col("x.w").alias("hit_ord"))
            .agg(F.max("x.word").alias("word"), F.max("x.start").alias("start"), F.max("x.end").alias("end"),
                 F.max("weight").alias("score")))


def strip_hits(hits: DataFrame, chars: str = TRAILING_PUNCT) -> DataFrame:
    """Trailing punctuation off each word, end offset moved back; empty words dropped."""
    stripped = strip_trailing("word", chars)
    return (hits.withColumn("end", F.col("end") - (F.length("word") - F.length(stripped)))
            .withColumn("word", stripped)
            .filter(F.col("word") != ""))


def merge_adjacent(hits: DataFrame) -> DataFrame:
    """Merge hits whose start is at most one char after the previous hit's end.

    Islands by ``lag(end)`` and a running sum; text = words joined by a blank,
    end = the last hit's end, score = running pairwise average in start order.
    """
    w = Window.partitionBy("posting_id", "model").orderBy("start", "hit_ord")
    gap_start = F.lag("end").over(w).isNull() | ((F.col("start") - F.lag("end").over(w)) > 1)
    flagged = hits.withColumn("new_island", gap_start.cast("long"))
    islands = flagged.withColumn(
        "island", F.sum("new_island").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    grouped = islands.groupBy("posting_id", "model", "island").agg(
        F.sort_array(F.collect_list(F.struct("start", "hit_ord", "word", "end", "score"))).alias("l"))
    first = F.col("l")[0]
    avg = F.aggregate(F.slice("l", 2, F.size("l")), first["score"],
                      lambda acc, x: (acc + x["score"]) / F.lit(2.0))
    return grouped.select(
        "posting_id", "model",
        F.array_join(F.transform("l", lambda x: x["word"]), " ").alias("word"),
        first["start"].alias("start"),
        F.element_at("l", -1)["end"].alias("end"),
        avg.alias("score"),
        F.size("l").alias("n_hits"),
    )


def tagger_spans(merged: DataFrame, models: list[str], tagger_name: str,
                 id_infix: str) -> DataFrame:
    """Spans of the tagger: all hits of the first model, then the next, by start."""
    order = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])
    ranked = merged.withColumn("kind_ord", F.element_at(order, F.col("model")).cast("int"))
    w = Window.partitionBy("posting_id").orderBy("kind_ord", "start", "end")
    n = F.row_number().over(w)
    return ranked.select(
        F.concat_ws("-", "posting_id", F.lit(id_infix), n.cast("string")).alias("id"),
        "posting_id",
        F.col("word").alias("text"),
        F.col("model").alias("span_type"),
        F.col("start").alias("char_start"),
        F.col("end").alias("char_end"),
        F.lit(tagger_name).alias("extractor"),
        F.col("score").cast("double").alias("score"),
        F.lit(1).alias("extractor_ord"),
        "kind_ord",
    )


def tagger_slot(postings: DataFrame, tag_batch, key: str = "posting_id", text_col: str = "raw_text") -> DataFrame:
    """Run a token-classification model over the adverts with ``mapInPandas``.

    ``tag_batch(pdf) -> pdf`` gets (posting_id, raw_text) batches and returns
    raw hits with ``HIT_COLUMNS`` (one row per model and hit); the model is
    loaded once per Python worker by the callable. The output then goes
    through ``strip_hits`` and ``merge_adjacent`` like the dictionary hits.
    """
    schema = "posting_id string, model string, hit_ord long, word string, start long, end long, score double"

    def run(batches):
        for pdf in batches:
            yield tag_batch(pdf)

    return postings.select(F.col(key).alias("posting_id"), F.col(text_col).alias("raw_text")).mapInPandas(run, schema)


#: Windows given to the model at a time.
WINDOWS_AT_ONCE = 512


def text_windows(text: str, size: int, context: int) -> list[tuple[int, int, int, int, int]]:
    """(first word, start, end, owned from, owned to) of windows of at most ``size`` words that overlap by twice
    ``context``. Every character of the text is owned by one window; the ``context`` words around what a window owns are
    there to be seen only."""
    words = [m.span() for m in annotate.WORD.finditer(text)]
    step, out = size - 2 * context, []
    for at in range(0, len(words), step):
        first, last = max(0, at - context), min(len(words), at + step + context)
        out.append((first, words[first][0], words[last - 1][1], words[at][0] if at else 0,
                    words[at + step][0] if at + step < len(words) else len(text)))
    return out


def windowed_slot(postings: DataFrame, tag_batch, size: int, context: int, key: str = "posting_id",
                  text_col: str = "raw_text") -> DataFrame:
    """``tagger_slot`` for a model that reads at most ``size`` words at a time and needs at most ``context`` words on
    each side to decide on a word. It gets windows in place of whole texts (each with a posting_id of its own); a hit
    counts in the window that owns its start, with the offsets it has in the text, so each hit of a long text is found
    once. ``hit_ord`` is taken as the number of the hit's word in the window."""
    if size <= 2 * context:
        raise ValueError("a window must be longer than the context on both sides")
    schema = "posting_id string, model string, hit_ord long, word string, start long, end long, score double"

    def tagged(held: list[tuple]):
        import pandas as pd
        windows = pd.DataFrame(held, columns=["owner", "raw_text", "first", "shift", "low", "high"])
        windows["posting_id"] = windows.index.astype(str)
        hits = tag_batch(windows[["posting_id", "raw_text"]])
        hits = hits.merge(windows.drop(columns="raw_text"), on="posting_id")
        start = hits["start"] + hits["shift"]
        mine = (start >= hits["low"]) & (start < hits["high"])
        return pd.DataFrame({"posting_id": hits["owner"], "model": hits["model"], "hit_ord": hits["hit_ord"] + hits["first"],
                             "word": hits["word"], "start": start, "end": hits["end"] + hits["shift"],
                             "score": hits["score"]})[mine]

    def run(batches):
        held: list[tuple] = []
        for pdf in batches:
            for owner, text in zip(pdf["posting_id"], pdf["raw_text"]):
                for first, start, end, low, high in text_windows(text or "", size, context):
                    held.append((owner, text[start:end], first, start, low, high))
                    if len(held) == WINDOWS_AT_ONCE:
                        yield tagged(held)
                        held = []
        if held:
            yield tagged(held)

    return postings.select(F.col(key).alias("posting_id"), F.col(text_col).alias("raw_text")).mapInPandas(run, schema)
