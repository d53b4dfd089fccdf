"""Worked example: stored rank-1 mappings -> consolidation -> delivery (six requirements)."""

import csv
import json

from pyspark.sql import functions as F

from skillweave.config import DEFAULT
from skillweave.operators import annotate, extract, rdf, requirements

NS = "http://data.europa.eu/esco/skill/mini/"


def test_golden_requirements_and_delivery(spark, fix):
    adv = json.load(open(fix("worked_example_input.json"), encoding="utf-8"))
    text = adv["raw_text"]
    rows = list(csv.DictReader(open(fix("worked_example_rank1.csv"), encoding="utf-8")))
    # span order: rule spans 1..12, then tagger spans 1..10 (id number, not string order)
    rows.sort(key=lambda r: (r["extractor"] != "adj_noun", int(r["span_id"].split("-")[1])))
    spans = []
    for o, r in enumerate(rows, start=1):
        start = text.find(r["span_text"].split(" ")[0])  # located by its first word
        spans.append((adv["id"], o, r["span_id"], start, start + 1, r["concept"], float(r["score"]), r["decision"]))
    df = spark.createDataFrame(spans, "posting_id string, span_ord long, id string, char_start long, char_end long, "
                                      "concept string, mapping_score double, decision string")
    post = spark.createDataFrame([adv], "id string, source_uri string, crawl_date string, platform string, "
                                        "employer string, posting_date string, title string, raw_text string, isco_group int")
    sents = annotate.sentences(post, key="id")
    kinds = extract.classify_kinds(df, sents, DEFAULT.markers)
    acc = (kinds.filter(F.col("decision") == "accepted")
           .withColumn("concept_uri", F.concat(F.lit(NS), "concept")))
    req = requirements.consolidate(acc, post, DEFAULT.level_map, DEFAULT.fallback_level)
    got = [(r.req_ord, r.refers_to_competence.rsplit("/", 1)[1], r.requirement_kind, f"{r.provenance_confidence:.2f}",
            r.required_level) for r in req.orderBy("req_ord").collect()]
    assert got == [
        (1, "pflegeplanung", "must", "0.65", "DQR5"),
        (2, "pflegeausbildung", "must", "0.69", "DQR5"),
        (3, "grundpflege", "must", "0.93", "DQR5"),
        (4, "erste-hilfe", "nice_to_have", "0.54", "DQR5"),
        (5, "medikamentengabe", "must", "0.87", "DQR5"),
        (6, "pflegedokumentation", "nice_to_have", "1.00", "DQR5"),
    ]
    ttl = rdf.turtle_documents(post, req, DEFAULT.with_(full_keys=False)).first().turtle
    assert "data:posting_554479e9" in ttl and "ont:JobPosting" in ttl and "ont:Employer" in ttl
    assert all(f"data:req_554479e9_{i}" in ttl for i in range(1, 7))
    assert 'ont:provenanceConfidence "1.00"^^xsd:decimal' in ttl
    assert "employer:seniorenresidenz-am-stadtpark-ggmbh" in ttl


def test_posting_without_requirement_closes_statement_and_violates(spark, fix):
    from skillweave.operators import shapes
    adv = json.load(open(fix("example_posting.json"), encoding="utf-8"))
    adv.setdefault("isco_group", None)
    post = spark.createDataFrame([adv], "id string, source_uri string, crawl_date string, platform string, "
                                        "employer string, posting_date string, title string, raw_text string, isco_group int")
    empty = spark.createDataFrame([], "posting_id string, req_ord long, refers_to_competence string, "
                                      "required_level string, requirement_kind string, provenance_confidence double")
    ttl = rdf.turtle_documents(post, empty).first().turtle
    assert len(rdf.iris(post).first().posting_key) == 32
    assert ttl.rstrip().endswith('"^^xsd:anyURI .') and "hasRequirement" not in ttl
    v = shapes.validate(rdf.triples(post, empty), shapes.constraints(spark)).collect()
    assert [(r.constraint, r.path.rsplit("/", 1)[1]) for r in v] == [("minCount", "hasRequirement")]


def test_adverts_of_one_source_address_are_one_subject(spark, fix):
    from skillweave.operators import shapes
    adv = json.load(open(fix("example_posting.json"), encoding="utf-8"))
    adv.setdefault("isco_group", None)
    schema = ("id string, source_uri string, crawl_date string, platform string, employer string, posting_date string, "
              "title string, raw_text string, isco_group int")
    post = spark.createDataFrame([adv, {**adv, "id": "other"}], schema)
    req = spark.createDataFrame([(adv["id"], 1, NS + "x", "DQR5", "must", 0.5)],
                                "posting_id string, req_ord long, refers_to_competence string, required_level string, "
                                "requirement_kind string, provenance_confidence double")
    tr = rdf.triples(post, req)
    assert tr.count() == tr.drop("posting_id").distinct().count()
    v = shapes.validate(tr, shapes.constraints(spark))
    assert [r for r in v.collect() if r.constraint == "maxCount"] == []
    assert shapes.conforms(v.limit(0)).first().conforms


def test_what_an_advert_does_not_state_costs_no_document(spark):
    from skillweave.operators import rdf
    schema = ("id string, source_uri string, crawl_date string, platform string, employer string, posting_date string, "
              "title string, raw_text string, isco_group int")
    full = ["a", "https://x/1", "2024-01-01", "p", "Firma", "2024-01-01", "Titel", "t", 3]
    rows = [full] + [[f"m{i}"] + [None if j == i else v for j, v in enumerate(full)][1:] for i in (1, 4, 5, 6)]
    rows.append(["none", None, None, None, None, None, None, None, None])
    post = spark.createDataFrame(rows, schema)
    req = spark.createDataFrame([(r[0], 1, "https://c/1", "DQR4", "must", 0.5) for r in rows],
                                "posting_id string, req_ord long, refers_to_competence string, required_level string, "
                                "requirement_kind string, provenance_confidence double")
    docs = {r.posting_id: r.turtle for r in rdf.turtle_documents(post, req).collect()}
    assert len(docs) == len(rows) and all(docs.values())
    assert "rdfs:label \"Titel\"" not in docs["m6"] and "ont:issuedBy" in docs["m6"] and "ont:requiredLevel" in docs["m6"]
    assert "employer:" not in docs["m4"].split("@prefix xsd")[1] and "ont:sourceUrl" in docs["m4"]
    assert "a ont:JobPosting ;\n  ont:hasRequirement" in docs["none"]
    tr = rdf.triples(post, req)
    assert tr.where("s is null or o is null").count() == 0
    lines = [r.line for r in rdf.n_triples(tr).collect()]
    assert all(lines) and len(lines) == len(set(lines))
    # adverts of one address keep their requirements apart
    assert tr.where(tr.p.endswith("refersToCompetence")).count() == len(rows)
