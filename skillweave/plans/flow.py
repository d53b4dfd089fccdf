"""The whole advert-to-requirements flow as one lazily built DataFrame graph.

Each property is a DataFrame built on first use. Texts are scanned once, where they lie, for everything the
extractors need (``annotate.scan``); only candidates, spans and their windows are shuffled, by advert. The scan, spans
and mappings are kept (memory, spilling to disk) while the flow is in use; ``release`` frees them.

Models plug in as callables: ``annotator`` (texts -> token rows) or ``reader`` (tokens and sentences from one reading,
``operators.reader``), ``tag`` (texts -> raw hits; with ``tag_window`` = (words, context) in overlapping windows) and
``encode`` (texts -> vectors, under the name ``config.encoder``). Without them the deterministic defaults run. With ``vector_cache`` the
concept vectors are kept in that Parquet table, so each concept label is encoded once over all runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.config import DEFAULT, TAGGER_ID_INFIX, Config
from skillweave.operators import annotate, extract, reader, tagger


@dataclass
class Flow:
    postings: DataFrame  # id, source_uri, ..., raw_text, isco_group
    concepts: DataFrame  # uri, pref_label, alt_labels, definition, ord
    dictionary: DataFrame  # model, n, key, weight
    tagger_sizes: list[tuple[str, int]]  # (model, n) pairs of the dictionary
    tagger_models: list[str]
    config: Config = field(default_factory=lambda: DEFAULT)
    annotator: Callable | None = None
    tag: Callable | None = None
    encode: Callable | None = None
    vector_cache: str | None = None
    reader: Callable | None = None
    tag_window: tuple[int, int] | None = None
    _kept: list[DataFrame] = field(default_factory=list)

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._kept[-1]

    def release(self, *but: DataFrame) -> None:
        """Frees what the flow keeps, but for the tables named."""
        for df in self._kept:
            if not any(df is b for b in but):
                df.unpersist()
        self._kept[:] = but

    def fresh(self) -> Flow:
        """A flow of the same inputs and models that keeps nothing yet."""
        return Flow(self.postings, self.concepts, self.dictionary, self.tagger_sizes, self.tagger_models, self.config,
                    self.annotator, self.tag, self.encode, self.vector_cache, self.reader, self.tag_window)

    @property
    def encoder(self) -> str:
        """The encoder that matches spans to concepts."""
        return self.config.encoder if self.encode is not None else "trigram"

    def models(self) -> dict:
        """What runs in each slot, for the run's metadata."""
        name = lambda f, default: default if f is None else getattr(f, "__name__", type(f).__name__)
        return {"annotator": name(self.annotator or self.reader, "suffix rules"),
                "extractors": {"adj_noun": "adjective + head noun rule", self.config.tagger_name: name(
                    self.tag, "dictionary")},
                "tagger_models": self.tagger_models, "encoder": self.encoder}

    @cached_property
    def facts(self) -> DataFrame:
        """The adverts without their texts, kept: everything behind the scan needs no more of them."""
        return self._keep(self.postings.drop("raw_text"))

    # --- annotation -----------------------------------------------------
    @cached_property
    def parts(self) -> DataFrame:
        """Tokens and sentences of the reader in the slot."""
        return self._keep(reader.read_parts(self.postings, self.reader))

    @cached_property
    def spots(self) -> DataFrame:
        """Of the reader's tokens and sentences those that make spans and decide their kinds."""
        return self._keep(reader.read_spots(self.postings, self.reader, self.config.markers))

    @cached_property
    def tokens(self) -> DataFrame:
        if self.reader is not None:
            return reader.tokens_of(self.parts)
        if self.annotator is not None:
            return annotate.annotator_slot(self.postings, self.annotator, key="id")
        return annotate.tokens(self.postings, key="id")

    @cached_property
    def sentences(self) -> DataFrame:
        if self.reader is not None:
            return reader.sentences_of(self.parts)
        return annotate.sentences(self.postings, key="id")

    @cached_property
    def scanned(self) -> DataFrame:
        return self._keep(annotate.scan(self.postings, sorted({n for _, n in self.tagger_sizes}),
                                        tagger.key_bitmap(self.dictionary), self.config.markers))

    # --- extraction -----------------------------------------------------
    @cached_property
    def rule_spans(self) -> DataFrame:
        if self.reader is not None:
            return extract.adj_noun_spans(reader.tokens_of(self.spots), self.postings, key="id")
        if self.annotator is not None:
            return extract.adj_noun_spans(self.tokens, self.postings, key="id")
        return extract.rule_spans(self.scanned)

    @cached_property
    def raw_hits(self) -> DataFrame:
        if self.tag is not None and self.tag_window is not None:
            return tagger.windowed_slot(self.postings, self.tag, *self.tag_window, key="id")
        if self.tag is not None:
            return tagger.tagger_slot(self.postings, self.tag, key="id")
        return tagger.hits_of(self.scanned.select("posting_id", F.explode("grams").alias("g")), self.dictionary)

    @cached_property
    def hits(self) -> DataFrame:
        return tagger.strip_hits(self.raw_hits, self.config.trailing_punct)

    @cached_property
    def merged_hits(self) -> DataFrame:
        return tagger.merge_adjacent(self.hits)

    @cached_property
    def tagged_spans(self) -> DataFrame:
        return tagger.tagger_spans(self.merged_hits, self.tagger_models, self.config.tagger_name,
                                   TAGGER_ID_INFIX)

    @cached_property
    def spans(self) -> DataFrame:
        combined = extract.combine_spans(self.rule_spans, self.tagged_spans)
        if self.reader is not None:  # the model's own sentences decide
            return self._keep(extract.kinds_by_marked(combined, self.spots.where("part = 'sentence'")))
        marked = self.scanned.select("posting_id", F.explode("marked").alias("x")).select("posting_id", "x.*")
        return self._keep(extract.kinds_by_marked(combined, marked))

    @cached_property
    def span_counts(self) -> DataFrame:
        return extract.span_counts(self.spans, self.facts, ["adj_noun", self.config.tagger_name], key="id")

    @cached_property
    def drafts(self) -> DataFrame:
        return extract.drafts(self.postings, self.spans, key="id")

    # --- matching and consolidation --------------------------------------
    @cached_property
    def mappings(self) -> DataFrame:
        from skillweave.operators.requirements import map_spans
        c = self.config
        return self._keep(map_spans(self.spans, self.concepts, c.top_k, c.threshold, encoder=self.encoder,
                                    profiles=c.encoder_profiles, salt_buckets=c.salt_buckets, encode=self.encode,
                                    vectors=self.concept_vectors))

    @cached_property
    def concept_vectors(self) -> DataFrame | None:
        """(ord, vec) from the vector cache, brought up to date first; None without a cache."""
        if self.encode is None or self.vector_cache is None:
            return None
        from skillweave.operators.requirements import concept_passages
        from skillweave.sources import vector_store as store
        spark, passages = self.concepts.sparkSession, concept_passages(self.concepts, self.encoder,
                                                                       self.config.encoder_profiles)
        store.refresh(spark, self.vector_cache, passages, self.encoder, store.dense_encoder(self.encoder, self.encode))
        current = store.current_vectors(spark, self.vector_cache, passages, self.encoder)
        return current.select("uri", "vec").join(self.concepts.select("uri", "ord"), "uri").select("ord", "vec")

    @cached_property
    def accepted(self) -> DataFrame:
        from skillweave.operators.requirements import accepted_spans
        return accepted_spans(self.spans, self.mappings)

    @cached_property
    def requirements(self) -> DataFrame:
        from skillweave.operators.requirements import accepted_from_mappings, consolidate
        return self._keep(consolidate(accepted_from_mappings(self.mappings), self.facts, self.config.level_map,
                                      self.config.fallback_level))

    # --- reports ----------------------------------------------------------
    @cached_property
    def overlap(self) -> DataFrame:
        from skillweave.operators.compare import extractor_overlap
        return extractor_overlap(self.spans, "adj_noun", self.config.tagger_name)

    @cached_property
    def stage_counts(self) -> DataFrame:
        from skillweave.operators.counters import stage_counts
        return stage_counts(self)

    # --- delivery -----------------------------------------------------------
    @cached_property
    def triples(self) -> DataFrame:
        from skillweave.operators.rdf import triples
        return self._keep(triples(self.facts, self.requirements, self.config))

    @cached_property
    def turtle(self) -> DataFrame:
        from skillweave.operators.rdf import turtle_documents
        return turtle_documents(self.facts, self.requirements, self.config)
