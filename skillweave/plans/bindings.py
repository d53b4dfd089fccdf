"""Bindings of the data model onto the driver tables (``documents``, ``benchmark``,
``embeddings``, ``pages``).

* postings  <- documents: one advert per document, whole text as raw_text.
* concepts  <- benchmark: one taxonomy concept per benchmark passage.
* tagger dictionaries <- word 3-grams (model "skill") and 5-grams (model
  "knowledge") of the benchmark passages.
* vectors   <- embeddings: every vector is matched against all other vectors
  (self excluded); a second "model" squares each component, keeping its sign.
* raw adverts, faults among them <- documents (for the readers and the rejects)
  and pages (for the checks).

The oracle SQL in ``plans/oracle.py`` states the same bindings for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.config import ESCO_SKILL_NS

# Parameters of the bindings (not of the library).
TEST_MARKERS = ("nicht", "auch", "not", "pas")
SPARSE_THRESHOLD = 0.5
DENSE_THRESHOLD = 0.35
DENSE_FOLD_THRESHOLD = 0.30
TAGGER_SIZES = {"skill": 3, "knowledge": 5}
TAGGER_MODELS = ["skill", "knowledge"]
CONCEPT_NS = ESCO_SKILL_NS + "bench/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverts from documents, whole texts; the title is the first line that is not blank. Every 50th advert states
    the source address of the one before, so the delivered graph holds adverts that share one; some state no title,
    employer, date or address."""
    d = table(spark, sf_dir, "documents")
    unless = lambda m, r, c: F.when(F.col("doc_id") % m != r, c)
    doc = F.col("doc_id").cast("string")
    source = F.when(F.col("doc_id") % 50 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")
    return d.select(
        F.concat(F.lit("doc-"), doc).alias("id"),
        unless(61, 11, F.concat(F.lit("https://example.com/doc/"), source)).alias("source_uri"),
        F.lit("2024-01-01").alias("crawl_date"),
        F.col("source").alias("platform"),
        unless(53, 7, F.concat_ws(" ", F.col("source"), F.upper("lang"))).alias("employer"),
        unless(59, 5, F.lit("2024-01-01")).alias("posting_date"),
        unless(47, 3, F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))).alias("title"),
        F.col("text").alias("raw_text"),
        F.when(F.col("doc_id") % 11 == 10, F.lit(None)).otherwise(F.col("doc_id") % 11).cast("int").alias("isco_group"),
    )


#: An input of at most so many splits may be one file that cannot be split; it is dealt into DEALT tasks.
HANDFUL, DEALT = 4, 32


def spread(df: DataFrame) -> DataFrame:
    """An input of a handful of splits (they may all be one small file) is dealt out; any larger one stays where it
    lies, whatever the number of cores."""
    return df.repartition(DEALT) if df.rdd.getNumPartitions() <= HANDFUL else df


def with_faults(raw: DataFrame, number, *more: str) -> DataFrame:
    """Raw adverts, all fields strings, with one kind of fault for some ``number`` mod 29; columns ``more`` stay."""
    m = number % 29
    fault = lambda c, k, v: F.when(m == k, F.lit(v).cast("string")).otherwise(F.col(c).cast("string")).alias(c)
    return raw.select(
        F.when(m == 1, F.lit(None)).when(m.isin(2, 3), F.concat(F.lit("twin-"), F.floor(number / 29).cast("string")))
        .otherwise(F.col("id")).alias("id"),
        "source_uri", fault("crawl_date", 4, "01.01.2024"), fault("platform", 5, None), "employer",
        fault("posting_date", 6, "2024-02-30"), fault("title", 7, None), "raw_text", fault("isco_group", 8, "drei"), *more)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw adverts as JSON texts (``value``), further faults among them that only JSON can state, by the advert's
    number mod 29: a number (9) or a list (10) for a title, 3.0 (11), 3.5 (12) or a truth value (13) for isco_group,
    an object cut off (14), a text in place of an object (15); a null title (16) and a number for raw_text (17)."""
    p = postings(spark, sf_dir)
    number = F.regexp_extract("id", r"([0-9]+)$", 1).cast("long")
    raw = with_faults(p.withColumn("n", number), F.col("n"), "n")
    m = F.col("n") % 29
    fields = [c for c in raw.columns if c != "n"]
    js = lambda **kw: F.to_json(F.struct(*[kw.get(c, F.col(c)).alias(c) for c in fields]), {"ignoreNullFields": "false"})
    plain = js()
    return raw.select(
        F.when(m == 9, js(title=F.lit(2024))).when(m == 10, js(title=F.array("title"))).when(m == 11, js(isco_group=F.lit(3.0)))
        .when(m == 12, js(isco_group=F.lit(3.5))).when(m == 13, js(isco_group=F.lit(True))).when(m == 14, F.substring(plain, 1, 40))
        .when(m == 15, F.concat(F.lit('"'), F.col("id"), F.lit('"'))).when(m == 16, js(title=F.lit(None).cast("string")))
        .when(m == 17, js(raw_text=F.lit(17))).otherwise(plain).alias("value"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skillweave.sources.adverts import page_postings
    p = page_postings(table(spark, sf_dir, "pages"))
    return with_faults(p, F.regexp_extract("id", r"([0-9]+)$", 1).cast("long"))


def line_reader():
    """Stand-in for a text model: the default tokens, and lines for sentences (restated in the oracle)."""
    from skillweave.operators import annotate
    line = annotate.regex.compile(r"[^\n]*\n+|[^\n]+")
    return lambda text: (annotate._tokens(text), [m.span() for m in line.finditer(text)])


#: Words on each side that the stand-in tagger looks at.
NEAR = 2


def noun_tagger(pdf):
    """Stand-in for a token classifier: words at most two from one that ends like a noun are hits, the nearer the higher
    their score (restated in the oracle)."""
    import pandas as pd

    from skillweave.config import TRAILING_PUNCT
    from skillweave.operators.annotate import WORD
    rows = []
    for owner, text in zip(pdf["posting_id"], pdf["raw_text"]):
        words = [(m.group(), *m.span()) for m in WORD.finditer(text or "")]
        nouns = [i for i, (w, _, _) in enumerate(words) if w.rstrip(TRAILING_PUNCT).lower().endswith(("tion", "ung"))]
        away: dict[int, int] = {}
        for i in nouns:
            for j in range(max(0, i - NEAR), min(len(words), i + NEAR + 1)):
                away[j] = min(abs(i - j), away.get(j, NEAR))
        rows += [(owner, "skill", j, *words[j], 1.0 / (1 + d)) for j, d in away.items()]
    return pd.DataFrame(rows, columns=["posting_id", "model", "hit_ord", "word", "start", "end", "score"])


def hashed_trigrams(texts: list[str]):
    """Stand-in for a sentence encoder: counts of character trigrams in 64 slots (restated in the oracle)."""
    import numpy as np
    out = np.zeros((len(texts), 64))
    for row, text in zip(out, texts):
        c = [ord(x) for x in f" {text.lower()} "]
        for i in range(len(c) - 2):
            row[(c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 64] += 1
    return out


def hashed_pairs(texts: list[str]):
    """Another stand-in: counts of character pairs in 64 slots (restated in the oracle)."""
    import numpy as np
    out = np.zeros((len(texts), 64))
    for row, text in zip(out, texts):
        c = [ord(x) for x in f" {text.lower()} "]
        for i in range(len(c) - 1):
            row[(c[i] * 31 + c[i + 1]) % 64] += 1
    return out


ENCODERS = {"hashed-trigrams": hashed_trigrams, "hashed-pairs": hashed_pairs}


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept index from benchmark passages; ord = item_id (tie-break order)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.concat(F.lit(CONCEPT_NS), F.col("item_id").cast("string")).alias("uri"),
        F.col("text").alias("pref_label"),
        F.array().cast("array<string>").alias("alt_labels"),
        F.lit(None).cast("string").alias("definition"),
        F.col("item_id").cast("long").alias("ord"),
    )


def dense_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, index) of both models: columns model_id, key, vec (array<double>); all vectors on both sides."""
    e = table(spark, sf_dir, "embeddings")
    full = F.transform("embedding", lambda x: x.cast("double"))
    raw = F.transform(full, lambda x: x * F.abs(x))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x * x))
    base = e.select("vec_id", full.alias("full"), raw.alias("raw")).withColumn("norm", norm)
    vecs = base.select(
        "vec_id",
        F.explode(F.array(
            F.struct(F.lit("plain").alias("model_id"), F.col("full").alias("vec")),
            F.struct(F.lit("squared").alias("model_id"), F.transform("raw", lambda x: x / F.col("norm")).alias("vec")),
        )).alias("m"),
    ).select(F.col("m.model_id").alias("model_id"), F.col("vec_id").alias("key"), F.col("m.vec").alias("vec"))
    return vecs, vecs


def inject_faults(tr: DataFrame) -> DataFrame:
    """Triples with one kind of fault per posting class (document number mod 13),
    so every constraint kind of the delivery shapes is exercised."""
    from skillweave.config import ONTOLOGY_NS as ONT, XSD_NS
    m = F.when(F.col("posting_id").isNull(), F.lit(-1)).otherwise(
        F.regexp_extract("posting_id", r"([0-9]+)$", 1).cast("long") % 13)
    t = tr.withColumn("m_", m)
    p = F.col("p")
    t = t.filter(~((F.col("m_") == 1) & (p == ONT + "postingDate")))
    o = (F.when((F.col("m_") == 2) & (p == ONT + "postingDate"), F.lit("2024-13-45"))
         .when((F.col("m_") == 3) & (p == ONT + "requirementKind"), F.lit("maybe"))
         .when((F.col("m_") == 4) & (p == ONT + "provenanceConfidence"), F.lit("1.50"))
         .when((F.col("m_") == 7) & (p == ONT + "requiredLevel"), F.lit(ONT + "DQR9"))
         .otherwise(F.col("o")))
    kind = F.when((F.col("m_") == 6) & (p == ONT + "refersToCompetence"), F.lit("literal")).otherwise(F.col("o_kind"))
    dt = (F.when((F.col("m_") == 6) & (p == ONT + "refersToCompetence"), F.lit(XSD_NS + "string"))
          .when((F.col("m_") == 8) & (p == ONT + "sourceUrl"), F.lit(XSD_NS + "string"))
          .otherwise(F.col("datatype")))
    extra = (t.filter((F.col("m_") == 5) & (p == ONT + "issuedBy"))
             .withColumn("o", F.concat(F.col("o"), F.lit("-2"))))
    changed = t.withColumn("o", o).withColumn("o_kind", kind).withColumn("datatype", dt)
    return changed.unionByName(extra).drop("m_")
