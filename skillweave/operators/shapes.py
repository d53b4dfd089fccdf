"""Constraint table of the delivery format and validation of a triples table.

The constraints are the property shapes of the competence-data shapes file,
kept as one row per (target class, property path). Validation is plain
relational work: focus nodes are the ``rdf:type`` triples of a target class,
joined with the (broadcast, fixed-size) constraints and with their values;
cardinalities are counts per (focus, path), value checks are row predicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.config import ONTOLOGY_NS, RDF_TYPE, RDFS_LABEL, XSD_NS

ONT = ONTOLOGY_NS
ESCO_PATTERN = r"^http://data\.europa\.eu/esco/skill/"
DQR_PATTERN = r"^http://hr-qde\.org/ontology/DQR[1-8]$"
OCC_PATTERN = r"^http://data\.europa\.eu/esco/occupation/"

CONSTRAINT_SCHEMA = T.StructType([
    T.StructField("shape", T.StringType()), T.StructField("target_class", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("min_count", T.IntegerType()),
    T.StructField("max_count", T.IntegerType()), T.StructField("node_kind", T.StringType()),
    T.StructField("datatype", T.StringType()), T.StructField("pattern", T.StringType()),
    T.StructField("allowed", T.ArrayType(T.StringType())), T.StructField("min_incl", T.DoubleType()),
    T.StructField("max_incl", T.DoubleType()), T.StructField("min_excl", T.DoubleType()),
    T.StructField("min_length", T.IntegerType()), T.StructField("message", T.StringType()),
])

# FIXED VALUES: property shapes of the delivery format, in file order:
# (shape, class, path, minCount, maxCount, nodeKind, datatype, pattern, in, minIncl, maxIncl, minExcl,
#  minLength, English message)
_D, _S, _DT, _U = "decimal", "string", "date", "anyURI"
CONSTRAINT_ROWS = [
    ("LearnerShape", "Learner", "hasProfile", 1, 1, "IRI", None, None, None, None, None, None, None,
     "Learner must have exactly one CompetencyProfile."),
    ("CompetencyProfileShape", "CompetencyProfile", "containsCompetence", 1, None, "IRI", None, None, None, None,
     None, None, None, "CompetencyProfile must contain at least one AcquiredCompetence."),
    ("AcquiredCompetenceShape", "AcquiredCompetence", "acquiredCompetenceOf", 1, 1, "IRI", None, ESCO_PATTERN, None,
     None, None, None, None, "AcquiredCompetence must reference exactly one ESCO skill URI."),
    ("AcquiredCompetenceShape", "AcquiredCompetence", "hasProficiencyLevel", 1, 1, "IRI", None, DQR_PATTERN, None,
     None, None, None, None, "AcquiredCompetence must reference exactly one ProficiencyLevel DQR1-DQR8."),
    ("AcquiredCompetenceShape", "AcquiredCompetence", "provenanceConfidence", 1, 1, None, _D, None, None, 0.0, 1.0,
     None, None, "provenanceConfidence must be a decimal in 0.0 to 1.0."),
    ("AcquiredCompetenceShape", "AcquiredCompetence", "provenanceSource", None, 1, None, _S, None,
     ["cv", "transcript", "certificate", "reference", "self_declaration"], None, None, None, None, None),
    ("AcquiredCompetenceShape", "AcquiredCompetence", "acquiredOn", None, 1, None, _DT, None, None, None, None, None,
     None, None),
    ("EducationalModuleShape", "EducationalModule", "moduleCode", 1, 1, None, _S, None, None, None, None, None, 1,
     None),
    ("EducationalModuleShape", "EducationalModule", "rdfs:label", 1, None, None, None, None, None, None, None, None,
     None, None),
    ("EducationalModuleShape", "EducationalModule", "ects", 1, 1, None, _D, None, None, None, None, 0.0, None,
     "EducationalModule must carry a positive ECTS value."),
    ("EducationalModuleShape", "EducationalModule", "offeredBy", 1, 1, "IRI", None, None, None, None, None, None,
     None, "EducationalModule must reference exactly one HigherEducationInstitution."),
    ("EducationalModuleShape", "EducationalModule", "hasOutcome", 1, None, "IRI", None, None, None, None, None, None,
     None, "EducationalModule must have at least one LearningOutcome."),
    ("EducationalModuleShape", "EducationalModule", "hasUnmappedOutcome", None, None, "IRI", None, None, None, None,
     None, None, None, "If present, hasUnmappedOutcome must reference an UnmappedLearningOutcome IRI."),
    ("EducationalModuleShape", "EducationalModule", "requiresCompetence", None, None, "IRI", None, ESCO_PATTERN, None,
     None, None, None, None, None),
    ("EducationalModuleShape", "EducationalModule", "moduleType", None, 1, None, _S, None,
     ["Pflichtmodul", "Bachelorseminar", "Masterseminar", "Fachpraktikum", "Projektpraktikum", "Abschlussmodul"],
     None, None, None, None,
     "moduleType must be one of: Pflichtmodul, Bachelorseminar, Masterseminar, Fachpraktikum, Projektpraktikum, "
     "Abschlussmodul."),
    ("LearningOutcomeShape", "LearningOutcome", "targetsCompetence", 1, 1, "IRI", None, ESCO_PATTERN, None, None,
     None, None, None, "LearningOutcome must reference exactly one ESCO skill URI."),
    ("LearningOutcomeShape", "LearningOutcome", "targetLevel", 1, 1, "IRI", None, DQR_PATTERN, None, None, None,
     None, None, None),
    ("LearningOutcomeShape", "LearningOutcome", "provenanceConfidence", 1, 1, None, _D, None, None, 0.0, 1.0, None,
     None, None),
    ("LearningOutcomeShape", "LearningOutcome", "provenanceSource", None, 1, None, _S, None,
     ["module_handbook", "course_catalog"], None, None, None, None, None),
    ("UnmappedLearningOutcomeShape", "UnmappedLearningOutcome", "rdfs:label", 1, None, None, None, None, None, None,
     None, None, None, "UnmappedLearningOutcome must carry at least one rdfs:label for human review."),
    ("UnmappedLearningOutcomeShape", "UnmappedLearningOutcome", "reviewReason", 1, 1, None, _S, None, None, None,
     None, None, 1,
     "UnmappedLearningOutcome must carry exactly one reviewReason describing why no ESCO link was established."),
    ("UnmappedLearningOutcomeShape", "UnmappedLearningOutcome", "evidenceExcerpt", 1, 1, None, _S, None, None, None,
     None, None, 1,
     "UnmappedLearningOutcome must carry exactly one evidenceExcerpt from the source document for manual review."),
    ("UnmappedLearningOutcomeShape", "UnmappedLearningOutcome", "provenanceSource", None, 1, None, _S, None,
     ["module_handbook", "course_catalog"], None, None, None, None, None),
    ("UnmappedLearningOutcomeShape", "UnmappedLearningOutcome", "provenanceConfidence", None, 1, None, _D, None, None,
     0.0, 1.0, None, None, None),
    ("HigherEducationInstitutionShape", "HigherEducationInstitution", "rdfs:label", 1, None, None, None, None, None,
     None, None, None, None, None),
    ("HigherEducationInstitutionShape", "HigherEducationInstitution", "institutionType", None, 1, "IRI", None, None,
     None, None, None, None, None, None),
    ("JobPostingShape", "JobPosting", "postingDate", 1, 1, None, _DT, None, None, None, None, None, None,
     "JobPosting must carry a postingDate xsd:date."),
    ("JobPostingShape", "JobPosting", "issuedBy", 1, 1, "IRI", None, None, None, None, None, None, None,
     "JobPosting must reference exactly one Employer."),
    ("JobPostingShape", "JobPosting", "refersToOccupation", None, 1, "IRI", None, OCC_PATTERN, None, None, None,
     None, None, None),
    ("JobPostingShape", "JobPosting", "hasRequirement", 1, None, "IRI", None, None, None, None, None, None, None,
     None),
    ("JobPostingShape", "JobPosting", "sourceUrl", None, 1, None, _U, None, None, None, None, None, None, None),
    ("QualificationRequirementShape", "QualificationRequirement", "refersToCompetence", 1, 1, "IRI", None,
     ESCO_PATTERN, None, None, None, None, None, None),
    ("QualificationRequirementShape", "QualificationRequirement", "requiredLevel", 1, 1, "IRI", None, DQR_PATTERN,
     None, None, None, None, None, None),
    ("QualificationRequirementShape", "QualificationRequirement", "requirementKind", 1, 1, None, _S, None,
     ["must", "nice_to_have"], None, None, None, None, "requirementKind must be must or nice_to_have."),
    ("QualificationRequirementShape", "QualificationRequirement", "provenanceConfidence", 1, 1, None, _D, None, None,
     0.0, 1.0, None, None, None),
    ("QualificationRequirementShape", "QualificationRequirement", "provenanceSource", None, 1, None, _S, None,
     ["job_posting", "company_profile"], None, None, None, None, None),
    ("EmployerShape", "Employer", "rdfs:label", 1, None, None, None, None, None, None, None, None, None, None),
]


def _expand(row):
    shape, cls, path, *rest = row
    dt = rest[3]
    full_path = RDFS_LABEL if path == "rdfs:label" else ONT + path
    return (shape, ONT + cls, full_path, rest[0], rest[1], rest[2], XSD_NS + dt if dt else None, *rest[4:])


def constraints(spark: SparkSession) -> DataFrame:
    """One row per property shape (10 classes, 37 paths)."""
    return spark.createDataFrame([_expand(r) for r in CONSTRAINT_ROWS], CONSTRAINT_SCHEMA)


def validate(triples: DataFrame, cons: DataFrame) -> DataFrame:
    """Violations (focus, shape, path, constraint, value, message); none = conforms."""
    focus = (triples.filter(F.col("p") == RDF_TYPE)
             .select(F.col("s").alias("focus"), F.col("o").alias("target_class")).distinct())
    # The constraint table is fixed data (37 rows): a proven size bound.
    fc = focus.join(F.broadcast(cons.withColumnRenamed("datatype", "datatype_c")), "target_class")
    # a graph is a set: a value stated twice is one value
    vals = triples.select(F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", "datatype", "lang").distinct()
    fv = fc.join(vals, ["focus", "path"], "left")
    base = ["focus", "shape", "path", "message"]

    # values are counted where the join put them: one pass gives both the counts and the faults of single values
    same = Window.partitionBy(*base, "min_count", "max_count")
    fv = fv.select("*", F.count("o").over(same).alias("n"),
                   F.row_number().over(same.orderBy("o", "o_kind", "datatype", "lang")).alias("nth"))
    count_of = lambda cond, name: F.when((F.col("nth") == 1) & cond, _found(name, F.col("n").cast("string")))
    fault = lambda cond, name: F.when(F.col("o").isNotNull() & cond, _found(name, F.col("o")))

    num = F.col("o").try_cast("decimal(38,18)")
    is_date = F.col("datatype") == XSD_NS + "date"
    is_dec = F.col("datatype") == XSD_NS + "decimal"
    ill_formed = ((is_date & F.try_to_date("o", "yyyy-MM-dd").isNull())
                  | (is_dec & (num.isNull() | ~F.col("o").rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"))))
    has = lambda c: F.col(c).isNotNull()
    known = lambda c: F.coalesce(c, F.lit(False))
    checks = F.array(
        count_of(F.col("n") < F.col("min_count"), "minCount"),
        count_of(F.col("n") > F.col("max_count"), "maxCount"),
        fault(has("node_kind") & (F.col("o_kind") != "iri"), "nodeKind"),
        fault(has("datatype_c") & ((F.col("o_kind") != "literal") | ~known(F.col("datatype") == F.col("datatype_c")) | ill_formed),
              "datatype"),
        fault(has("pattern") & ~F.regexp_like(F.col("o"), F.col("pattern")), "pattern"),
        fault(has("allowed") & ~((F.col("o_kind") == "literal") & known(F.col("datatype") == XSD_NS + "string")
                                 & F.array_contains("allowed", F.col("o"))), "in"),
        fault(has("min_incl") & ~known(num >= F.col("min_incl")), "minInclusive"),
        fault(has("max_incl") & ~known(num <= F.col("max_incl")), "maxInclusive"),
        fault(has("min_excl") & ~known(num > F.col("min_excl")), "minExclusive"),
        fault(has("min_length") & (F.length("o") < F.col("min_length")), "minLength"),
    )
    return (fv.select(*base, F.explode(F.array_compact(checks)).alias("found"))
            .select(*base, "found.constraint", "found.value"))


def _found(name: str, value):
    return F.struct(F.lit(name).alias("constraint"), value.alias("value"))


def conforms(violations: DataFrame) -> DataFrame:
    """One row: whether there is no violation, and how many there are."""
    return violations.agg(F.count("*").alias("n_violations")).select((F.col("n_violations") == 0).alias("conforms"),
                                                                     "n_violations")
