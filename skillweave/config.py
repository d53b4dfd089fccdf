"""Run parameters of the skill-extraction flow.

Everything that decides a result lives here as plain data; operators take a
``Config`` (or the single value they need) instead of reading globals.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the values of the job-advert pipeline this
# library re-implements, otherwise results differ. Kept together, in their
# natural order, as plain text.
# ---------------------------------------------------------------------------

# Nice-to-have signal words (case-insensitive, unanchored substring match).
NICE_TO_HAVE_MARKERS = (
    "erwünscht",
    "wünschenswert",
    "von vorteil",
    "idealerweise",
    "ein plus",
    "bevorzugt",
    "optional",
    "nice to have",
    "preferred",
    "would be a plus",
)

MAPPING_THRESHOLD = 0.5
MAPPING_TOP_K = 3

# Characters stripped from the end of a tagger hit.
TRAILING_PUNCT = ".,;:!?)"

# Qualification level per ISCO major group; anything else falls back.
ISCO_MAJOR_GROUP_LEVEL = {
    1: "DQR7",
    2: "DQR6",
    3: "DQR5",
    4: "DQR4",
    5: "DQR4",
    6: "DQR3",
    7: "DQR3",
    8: "DQR3",
    9: "DQR2",
}
FALLBACK_LEVEL = "DQR4"

# Encoder input prefixes per model id (models not listed get no prefix).
ENCODER_PROFILES = {
    "TechWolf/ConTeXT-Skill-Extraction-base": {},
    "sentence-transformers/paraphrase-multilingual-mpnet-base-v2": {},
    "isy-thl/multilingual-e5-base-course-skill-tuned": {
        "query_prefix": "query: ",
        "passage_prefix": "passage: ",
    },
}
DEFAULT_ENCODER = "TechWolf/ConTeXT-Skill-Extraction-base"

# Employer slug: lower-case, runs outside [a-z0-9] become "-", fallback word.
SLUG_FALLBACK = "unbenannt"

# Posting key: first 8 hex digits of uuid5(NAMESPACE_URL, source_uri).
UUID_NAMESPACE_URL_HEX = "6ba7b8119dad11d180b400c04fd430c8"

# RDF vocabulary of the delivery format and of its constraint shapes.
ONTOLOGY_NS = "http://hr-qde.org/ontology/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD_NS = "http://www.w3.org/2001/XMLSchema#"
RDF_LANGSTRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
ESCO_SKILL_NS = "http://data.europa.eu/esco/skill/"
PROVENANCE_SOURCE = "job_posting"
LABEL_LANG = "de"

# Span-id infixes and extractor names.
RULE_EXTRACTOR = "adj_noun"
RULE_ID_INFIX = "adjn"
TAGGER_ID_INFIX = "esco"

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """Parameters of one run. All fields have the defaults above."""

    markers: tuple[str, ...] = NICE_TO_HAVE_MARKERS
    threshold: float = MAPPING_THRESHOLD
    top_k: int = MAPPING_TOP_K
    level_map: dict = field(default_factory=lambda: dict(ISCO_MAJOR_GROUP_LEVEL))
    fallback_level: str = FALLBACK_LEVEL
    encoder_profiles: dict = field(default_factory=lambda: dict(ENCODER_PROFILES))
    encoder: str = DEFAULT_ENCODER
    trailing_punct: str = TRAILING_PUNCT
    # Namespaces of the delivered data (subjects). The ontology namespace is fixed.
    data_ns: str = "http://example.org/demand/"
    employer_ns: str = "http://example.org/demand/employer/"
    tagger_name: str = "tagger"
    # IRIs with the full 128-bit key of the source address; False gives the short 32-bit form.
    full_keys: bool = True
    # Salt buckets for joins on a possibly hot key (span text).
    salt_buckets: int = 16

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)


DEFAULT = Config()
