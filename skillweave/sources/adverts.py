"""Advert sources: JSON (object or array, or JSON lines), Parquet, raw web pages;
and the required-field / type / duplicate check.

JSON is read through VARIANT, so the type a field has in the file is seen: a number or an array where a text belongs is
a fault and not a text, an integral number such as 3.0 is an isco_group, and a line that is no JSON is a reject that
keeps its text. Dates stay the strings they are; one that is not ISO is reported and does not cost the advert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ["id", "source_uri", "crawl_date", "platform", "employer", "posting_date", "title", "raw_text"]
DATES = ["crawl_date", "posting_date"]

POSTING = T.StructType([T.StructField(c, T.StringType(), True) for c in REQUIRED]
                       + [T.StructField("isco_group", T.IntegerType(), True)])

# Every field as string, so a bad isco_group is reported instead of nulled.
_RAW = T.StructType([T.StructField(c, T.StringType(), True) for c in REQUIRED + ["isco_group"]])


def read_postings(spark: SparkSession, path: str, fmt: str = "json", multiline: bool = True,
                  validate: bool = True, strict: bool = False) -> DataFrame:
    """Adverts with the declared schema.

    ``multiline`` JSON reads a file holding one object or an array of objects;
    ``multiline=False`` reads JSON lines (splittable, the choice at scale).
    With ``validate`` the invalid rows are left out (``strict`` raises instead); ``rejected`` gives them with their
    reasons. Adverts that share an id are kept, first and later ones alike, and reported by ``validate_postings``.
    """
    raw = read_raw(spark, path, fmt, multiline)
    if not validate:
        return _typed(raw)
    if strict:
        bad = rejected(raw).limit(1).collect()
        if bad:
            raise ValueError(f"invalid advert {bad[0]['id']}: {bad[0]['reasons']}")
    return accepted(raw)


def read_raw(spark: SparkSession, path: str, fmt: str = "json", multiline: bool = True) -> DataFrame:
    """Adverts as read, nothing left out: the fields as strings, ``wrong`` (names of fields of another type; ``json``
    for what is no JSON, ``record`` for JSON that is no object) and ``record``, the text of the latter two."""
    if fmt == "parquet":
        return _from_columns(spark.read.parquet(path))
    return parsed(spark.read.text(path, wholetext=multiline), multiline)


def parsed(text: DataFrame, multiline: bool = False) -> DataFrame:
    """The same from a table of JSON texts (``value``), batch or stream; blank ones are no adverts."""
    # read as the one element of an array, so what follows the value on its line is seen as well
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]"))), "$", "array<variant>")
    whole = F.rtrim("value", F.lit(" \t\r\n")).rlike('[\\]}"0-9a-z]$')
    # exploded, as a filter or a field further on would otherwise parse the text once more for each use
    lines = text.where(~F.col("value").rlike(r"^\s*$")).select("value", F.explode(F.array(one)).alias("one"))
    docs = lines.select("value", F.when((F.size("one") == 1) & whole, F.get("one", F.lit(0))).alias("doc"))
    if multiline:  # an array's elements are adverts, anything else is one
        items = F.coalesce(F.try_variant_get("doc", "$", "array<variant>"), F.array("doc"))
        docs = docs.select("value", F.explode(items).alias("doc"))
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    fields = {c: F.try_variant_get("doc", f"$.{c}", "variant") for c in REQUIRED + ["isco_group"]}
    kind = {c: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) for c, v in fields.items()}  # VOID: null or not there
    as_text = lambda c: F.try_variant_get("doc", f"$.{c}", "string")
    number = F.col("kind.isco_group").isin("BIGINT", "DOUBLE", "FLOAT") | F.col("kind.isco_group").startswith("DECIMAL")
    fault = [F.when(~F.col("kind")[c].isin("STRING", "VOID"), F.lit(c)) for c in REQUIRED]
    fault.append(F.when(~(number | F.col("kind.isco_group").isin("STRING", "VOID")), F.lit("isco_group")))
    fields_of = F.struct(is_object.alias("sound"), F.col("doc").isNull().alias("cut"), F.struct(*[kind[c].alias(c) for c in kind])
                         .alias("kind"), F.struct(*[as_text(c).alias(c) for c in kind]).alias("said"))
    read = docs.select("value", F.explode(F.array(fields_of)).alias("read")).select("value", "read.*")
    broken = F.when(F.col("cut"), F.lit("json")).otherwise(F.lit("record"))
    return read.select(
        *[F.when(F.col("kind")[c] == "STRING", F.col("said")[c]).alias(c) for c in REQUIRED],
        F.when(number | (F.col("kind.isco_group") == "STRING"), F.col("said.isco_group")).alias("isco_group"),
        F.when(F.col("sound"), F.array_compact(F.array(*fault))).otherwise(F.array(broken)).alias("wrong"),
        F.when(~F.col("sound"), F.col("value")).alias("record"))


def _from_columns(table: DataFrame) -> DataFrame:
    """The same from typed columns; a text column of another type is wrong where it has a value."""
    kinds = {f.name: f.dataType for f in table.schema.fields}
    texts = [F.col(c).cast("string").alias(c) if isinstance(kinds.get(c), T.StringType) else F.lit(None).cast("string").alias(c)
             for c in REQUIRED]
    fault = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in REQUIRED
             if c in kinds and not isinstance(kinds[c], T.StringType)]
    isco = F.lit(None).cast("string")
    if "isco_group" in kinds:
        if isinstance(kinds["isco_group"], (T.NumericType, T.StringType)):
            isco = F.col("isco_group").cast("string")
        else:
            fault.append(F.when(F.col("isco_group").isNotNull(), F.lit("isco_group")))
    return table.select(*texts, isco.alias("isco_group"), F.array_compact(F.array(*fault)).cast("array<string>").alias("wrong"),
                        F.lit(None).cast("string").alias("record"))


def isco_number(column="isco_group"):
    """The integer a text states, with or without a fraction of zeros; null for any other."""
    value = F.trim(F.col(column).cast("string")).try_cast("decimal(38,18)")
    return F.when(value == F.floor(value), value.try_cast("int"))


def problems(raw: DataFrame):
    """Reasons why a row is no advert, ``|``-joined, '' when it is one: it is no JSON or no object, a required field is
    missing or of another type, isco_group is no integer."""
    wrong = F.col("wrong") if "wrong" in raw.columns else F.array().cast("array<string>")
    has = lambda c: F.array_contains(wrong, c)
    whole = ~(has("json") | has("record"))
    checks = [F.when(has("json"), "bad_json"), F.when(has("record"), "bad_type:record")]
    checks += [F.when(has(c), f"bad_type:{c}").when(whole & F.col(c).isNull(), f"missing:{c}") for c in REQUIRED]
    checks.append(F.when(has("isco_group") | F.col("isco_group").isNotNull() & isco_number().isNull(), "bad_type:isco_group"))
    return F.concat_ws("|", *checks)


def quality():
    """What is odd about an advert without making it invalid: dates that are not ISO (yyyy-MM-dd), ``|``-joined."""
    return F.concat_ws("|", *[F.when(F.col(c).isNotNull() & F.try_to_date(F.col(c), "yyyy-MM-dd").isNull(), f"bad_date:{c}")
                              for c in DATES])


def accepted(raw: DataFrame) -> DataFrame:
    """Valid adverts, typed. With ``rejected`` every row of ``raw`` is in one of both."""
    return _typed(raw.filter(problems(raw) == ""))


def rejected(raw: DataFrame) -> DataFrame:
    """Invalid rows as read, with their reasons; ``record`` is the text of those that are no JSON object."""
    out = raw if "record" in raw.columns else raw.withColumn("record", F.lit(None).cast("string"))
    return out.withColumn("reasons", problems(raw)).filter(F.col("reasons") != "")


def _typed(raw: DataFrame) -> DataFrame:
    return raw.select(*REQUIRED, isco_number().alias("isco_group"))


def validate_postings(raw: DataFrame) -> DataFrame:
    """Per advert: reasons (``|``-joined, '' when there are none), is_valid, n_same_id.

    Reasons are those of ``problems``, and two that are reported but do not make an advert invalid: those of
    ``quality``, and ``duplicate_id`` for an id on several adverts (their output files would overwrite each other). The
    checks come first, so only ids and reasons are shuffled; ids are counted, not gathered, and missing ids are no
    duplicates of each other."""
    checked = raw.select("id", "source_uri", problems(raw).alias("own"), quality().alias("odd"))
    repeated = (checked.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
                .withColumnRenamed("id", "again"))
    out = checked.join(repeated, F.col("id") == F.col("again"), "left")
    reasons = F.concat_ws("|", F.nullif("own", F.lit("")), F.nullif("odd", F.lit("")), F.when(F.col("n") > 1, F.lit("duplicate_id")))
    return out.select("id", "source_uri", reasons.alias("reasons"), (F.col("own") == "").alias("is_valid"),
                      F.coalesce("n", F.lit(1)).cast("long").alias("n_same_id"))


def page_postings(pages: DataFrame) -> DataFrame:
    """Adverts from raw web pages (page_id, url, html): id from page_id,
    employer = host, title = <title> (missing when empty), text = the HTML."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        F.col("url").alias("source_uri"),
        F.lit("2024-01-01").alias("crawl_date"),
        host.alias("platform"),
        host.alias("employer"),
        F.lit("2024-01-01").alias("posting_date"),
        F.nullif(title, F.lit("")).alias("title"),
        F.col("html").alias("raw_text"),
        F.lit(None).cast("string").alias("isco_group"),
    )
