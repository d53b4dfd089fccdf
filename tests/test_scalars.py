"""Row-wise helpers: slug, posting key, levels, markers, punctuation, formatting."""

from pyspark.sql import functions as F

from skillweave.functions import fmt, levels
from skillweave.functions import text as T


def test_slug_cases(spark):
    df = spark.createDataFrame([("Müller & Söhne",), ("!!!",), ("Beispiel GmbH",)], "e string")
    got = [r[0] for r in df.select(T.employer_slug("e")).collect()]
    assert got == ["m-ller-s-hne", "unbenannt", "beispiel-gmbh"]


def test_posting_key_and_uuid(spark):
    df = spark.createDataFrame([("https://example.com/stellen/pflege-fachkraft-002",)], "u string")
    r = df.select(T.posting_key("u").alias("k"), T.posting_uuid("u").alias("x")).first()
    assert r.k == "554479e9"
    import uuid
    assert r.x == uuid.uuid5(uuid.NAMESPACE_URL, "https://example.com/stellen/pflege-fachkraft-002").hex


def test_levels(spark):
    df = spark.createDataFrame([(None,), (0,), (1,), (9,), (3,)], "g int")
    got = df.select(levels.required_level("g").alias("l"), levels.level_is_fallback("g").alias("f")).collect()
    assert [(r.l, r.f) for r in got] == [("DQR4", True), ("DQR4", True), ("DQR7", False), ("DQR2", False),
                                         ("DQR5", False)]


def test_marker_case_insensitive_unicode(spark):
    df = spark.createDataFrame([("ERWÜNSCHT",), ("optionale Kenntnisse",), ("Pflicht",)], "t string")
    from skillweave.config import NICE_TO_HAVE_MARKERS
    got = [r[0] for r in df.select(T.has_marker("t", NICE_TO_HAVE_MARKERS)).collect()]
    assert got == [True, True, False]


def test_strip_trailing(spark):
    df = spark.createDataFrame([("Java).",), (").",), ("a.b",)], "w string")
    assert [r[0] for r in df.select(T.strip_trailing("w")).collect()] == ["Java", "", "a.b"]


def test_fixed_matches_python_rounding(spark):
    vals = [0.625, 1.005, 0.125, 0.65, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(fmt.fixed("x", 2)).collect()]
    assert got == [f"{v:.2f}" for v in vals]


def test_encoder_prefix(spark):
    from skillweave.config import ENCODER_PROFILES
    df = spark.createDataFrame([("isy-thl/multilingual-e5-base-course-skill-tuned",), ("unknown",)], "m string")
    got = [r[0] for r in df.select(T.encoder_prefix(ENCODER_PROFILES, "m", "query")).collect()]
    assert got == ["query: ", ""]
