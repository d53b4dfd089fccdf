"""RDF delivery: a triples table and per-posting Turtle documents.

Triples: (posting_id, s, p, o, o_kind, datatype, lang), each once however many
adverts state it (posting_id is then the smallest); posting_id is null for
employer triples, which come from the distinct employers. Literals are escaped
in Turtle output.

IRIs carry the full key of the source address (``Config.full_keys``, the
default): 32-bit keys, the short form, meet by chance from some ten thousand
adverts on. Under full keys the key of a requirement also covers the advert's
id, so adverts that share an address do not share their requirements' nodes.

What an advert does not state is left out and the rest is delivered: no title,
date or address means no such triple, no employer means no employer node. An
advert without an address gets its key from its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.config import (DEFAULT, LABEL_LANG, ONTOLOGY_NS, PROVENANCE_SOURCE, RDF_LANGSTRING, RDF_TYPE,
                               RDFS_LABEL, XSD_NS, Config)
from skillweave.functions.fmt import fixed
from skillweave.functions.text import employer_slug, posting_key, posting_uuid

XSD_STRING = XSD_NS + "string"
XSD_DATE = XSD_NS + "date"
XSD_ANYURI = XSD_NS + "anyURI"
XSD_DECIMAL = XSD_NS + "decimal"
ONT = ONTOLOGY_NS


def _t(s, p, o, kind: str, datatype: str | None = None, lang: str | None = None):
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
                    F.lit(datatype).cast("string").alias("datatype"), F.lit(lang).cast("string").alias("lang"))


def _emit(df: DataFrame, posting_col, items) -> DataFrame:
    """One row for each item that states something."""
    return df.select(posting_col.alias("posting_id"), F.explode(F.array(*items)).alias("t")).select(
        "posting_id", "t.*").where("s is not null and o is not null")


def iris(postings: DataFrame, cfg: Config = DEFAULT, key: str = "id") -> DataFrame:
    """Per posting: posting key, key of its requirements, posting IRI and employer IRI (null without an employer)."""
    address = F.coalesce(F.col("source_uri"), F.col(key))
    k = posting_uuid(address) if cfg.full_keys else posting_key(address)
    own = posting_uuid(F.concat(address, F.lit("#"), F.col(key))) if cfg.full_keys else k
    return postings.select(
        F.col(key).alias("posting_id"), k.alias("posting_key"), own.alias("requirement_key"),
        F.concat(F.lit(cfg.data_ns + "posting_"), k).alias("posting_iri"),
        F.when(F.col("employer").isNotNull(), F.concat(F.lit(cfg.employer_ns), employer_slug("employer"))).alias("employer_iri"),
        "employer", "title", "posting_date", "source_uri",
    )


def triples(postings: DataFrame, requirements: DataFrame, cfg: Config = DEFAULT, key: str = "id") -> DataFrame:
    ids = iris(postings, cfg, key)
    emp = ids.select("employer_iri", "employer").where("employer is not null").distinct()
    emp_type = emp.select("employer_iri").distinct()
    e1 = emp_type.select(F.lit(None).cast("string").alias("posting_id"), F.col("employer_iri").alias("s"),
                         F.lit(RDF_TYPE).alias("p"), F.lit(ONT + "Employer").alias("o"), F.lit("iri").alias("o_kind"),
                         F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    e2 = emp.select(F.lit(None).cast("string").alias("posting_id"), F.col("employer_iri").alias("s"),
                    F.lit(RDFS_LABEL).alias("p"), F.col("employer").alias("o"), F.lit("literal").alias("o_kind"),
                    F.lit(RDF_LANGSTRING).alias("datatype"), F.lit(LABEL_LANG).alias("lang"))
    s = F.col("posting_iri")
    post = _emit(ids, F.col("posting_id"), [
        _t(s, RDF_TYPE, F.lit(ONT + "JobPosting"), "iri"),
        _t(s, RDFS_LABEL, F.col("title"), "literal", RDF_LANGSTRING, LABEL_LANG),
        _t(s, ONT + "postingDate", F.col("posting_date"), "literal", XSD_DATE),
        _t(s, ONT + "issuedBy", F.col("employer_iri"), "iri"),
        _t(s, ONT + "sourceUrl", F.col("source_uri"), "literal", XSD_ANYURI),
    ])
    req = requirements.join(ids.select("posting_id", "requirement_key", "posting_iri"), "posting_id")
    r = F.concat(F.lit(cfg.data_ns + "req_"), F.col("requirement_key"), F.lit("_"), F.col("req_ord").cast("string"))
    req = req.withColumn("req_iri", r)
    ri = F.col("req_iri")
    reqs = _emit(req, F.col("posting_id"), [
        _t(F.col("posting_iri"), ONT + "hasRequirement", ri, "iri"),
        _t(ri, RDF_TYPE, F.lit(ONT + "QualificationRequirement"), "iri"),
        _t(ri, ONT + "refersToCompetence", F.col("refers_to_competence"), "iri"),
        _t(ri, ONT + "requiredLevel", F.concat(F.lit(ONT), F.col("required_level")), "iri"),
        _t(ri, ONT + "requirementKind", F.col("requirement_kind"), "literal", XSD_STRING),
        _t(ri, ONT + "provenanceConfidence", fixed("provenance_confidence", 2), "literal", XSD_DECIMAL),
        _t(ri, ONT + "provenanceSource", F.lit(PROVENANCE_SOURCE), "literal", XSD_STRING),
    ])
    stated = post.unionByName(reqs).groupBy("s", "p", "o", "o_kind", "datatype", "lang").agg(
        F.min("posting_id").alias("posting_id"))
    return e1.unionByName(e2).unionByName(stated)


def escape_literal(c) -> F.Column:
    """Turtle string escaping of backslash, quote, newline, carriage return."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("\r"), F.lit("\\r"))


def n_triples(tr: DataFrame) -> DataFrame:
    """One N-Triples line per triple (sharded text sink)."""
    obj = (F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">")))
           .when(F.col("lang").isNotNull(), F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"@'), "lang"))
           .otherwise(F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"^^<'), "datatype", F.lit(">"))))
    return tr.select("posting_id", F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), obj, F.lit(" .")).alias("line"))


def turtle_prefixes(cfg: Config = DEFAULT) -> str:
    return (f"@prefix ont: <{ONT}> .\n"
            f"@prefix data: <{cfg.data_ns}> .\n"
            f"@prefix employer: <{cfg.employer_ns}> .\n"
            "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
            f"@prefix xsd: <{XSD_NS}> .\n\n")


def turtle_documents(postings: DataFrame, requirements: DataFrame, cfg: Config = DEFAULT,
                     key: str = "id") -> DataFrame:
    """(posting_id, file_name, turtle): one Turtle document per posting.

    Layout: employer block, posting block (hasRequirement list, or the last
    statement closed with a period when there is none), one block per
    requirement in requirement order.
    """
    ids = iris(postings, cfg, key)
    slug = employer_slug("employer")
    req_name = F.concat(F.lit("data:req_"), F.col("requirement_key"), F.lit("_"), F.col("req_ord").cast("string"))
    block = F.concat(
        req_name, F.lit("\n  a ont:QualificationRequirement ;\n"),
        F.lit("  ont:refersToCompetence <"), F.col("refers_to_competence"), F.lit("> ;\n"),
        F.lit("  ont:requiredLevel ont:"), F.col("required_level"), F.lit(" ;\n"),
        F.lit('  ont:requirementKind "'), F.col("requirement_kind"), F.lit('" ;\n'),
        F.lit('  ont:provenanceConfidence "'), fixed("provenance_confidence", 2), F.lit('"^^xsd:decimal ;\n'),
        F.lit(f'  ont:provenanceSource "{PROVENANCE_SOURCE}" .\n'),
    )
    req = (requirements.join(ids.select("posting_id", "requirement_key"), "posting_id")
           .select("posting_id", F.struct(F.col("req_ord"), req_name.alias("name"), block.alias("block")).alias("r"))
           .groupBy("posting_id").agg(F.sort_array(F.collect_list("r")).alias("rs")))
    doc = ids.join(req, "posting_id", "left").withColumn("rs", F.coalesce("rs", F.array().cast(req.schema["rs"].dataType)))
    has = F.size("rs") > 0
    stated = lambda c, *parts: F.when(F.col(c).isNotNull(), F.concat(*parts)).otherwise("")
    text = lambda c: escape_literal(F.col(c))
    head = F.concat(
        F.lit(turtle_prefixes(cfg)),
        stated("employer", F.lit("\nemployer:"), slug, F.lit("\n  a ont:Employer ;\n"),
               F.lit('  rdfs:label "'), text("employer"), F.lit('"@de .\n')),
        F.lit("\ndata:posting_"), F.col("posting_key"), F.lit("\n  a ont:JobPosting"),
        stated("title", F.lit(' ;\n  rdfs:label "'), text("title"), F.lit('"@de')),
        stated("posting_date", F.lit(' ;\n  ont:postingDate "'), text("posting_date"), F.lit('"^^xsd:date')),
        stated("employer", F.lit(" ;\n  ont:issuedBy employer:"), slug),
        stated("source_uri", F.lit(' ;\n  ont:sourceUrl "'), text("source_uri"), F.lit('"^^xsd:anyURI')),
    )
    reqlist = F.array_join(F.transform("rs", lambda x: x["name"]), " ,\n    ")
    tail = F.when(has, F.concat(F.lit(" ;\n  ont:hasRequirement "), reqlist, F.lit(" .\n\n"),
                                F.array_join(F.transform("rs", lambda x: x["block"]), "\n")))
    tail = F.coalesce(tail, F.lit(" .\n"))
    return doc.select("posting_id", F.concat(F.col("posting_id"), F.lit(".ttl")).alias("file_name"),
                      F.concat(head, tail).alias("turtle"))
