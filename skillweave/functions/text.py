"""Row-wise string helpers, all JVM-side column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillweave.config import SLUG_FALLBACK, TRAILING_PUNCT, UUID_NAMESPACE_URL_HEX


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _slug_expr(c: Column) -> Column:
    """Employer slug: lower, runs of ``[^a-z0-9]`` to ``-``, trim ``-``, fallback word."""
    dashed = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    trimmed = F.btrim(dashed, F.lit("-"))
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(SLUG_FALLBACK))


def employer_slug(c) -> Column:
    return _slug_expr(_col(c))


def posting_sha1(url) -> Column:
    """SHA-1 hex of (URL namespace bytes || utf-8 url), i.e. the uuid5 digest."""
    return F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE_URL_HEX)), F.encode(_col(url), "UTF-8")))


def posting_key(url) -> Column:
    """8-hex posting key: uuid5(NAMESPACE_URL, url).hex[:8] (version bits lie beyond)."""
    return F.substring(posting_sha1(url), 1, 8)


def posting_uuid(url) -> Column:
    """Full uuid5 hex (32 digits, version and variant bits set): collision-safe id."""
    h = posting_sha1(url)
    variant = F.substring(
        F.lit("89ab89ab89ab89ab"),
        F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)),
        F.lit(1),
    )
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant,
                    F.substring(h, 18, 15))


def marker_regex(markers: Iterable[str]) -> str:
    """Java regex matching any marker, case-insensitive incl. non-ASCII letters."""
    return "(?iu)(" + "|".join(re.escape(m) if not _plain(m) else m for m in markers) + ")"


def _plain(m: str) -> bool:
    return re.fullmatch(r"[\w ]+", m) is not None


def has_marker(c, markers: Iterable[str]) -> Column:
    return _col(c).rlike(marker_regex(markers))


def strip_trailing(c, chars: str = TRAILING_PUNCT) -> Column:
    """Remove any run of ``chars`` from the end of a string."""
    return F.rtrim(_col(c), F.lit(chars))


def encoder_prefix(profiles: dict, model_col, mode: str) -> Column:
    """Prefix per (model, mode); unknown models get ''."""
    entries = []
    for model_id, profile in profiles.items():
        pre = profile.get(f"{mode}_prefix")
        if pre:
            entries += [F.lit(model_id), F.lit(pre)]
    if not entries:
        return F.lit("")
    return F.coalesce(F.try_element_at(F.create_map(*entries), _col(model_col)), F.lit(""))


def short_hash(*cols, n: int = 32) -> Column:
    """Deterministic id from column values (stable across task retries); 128 bits by default."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *[_col(c) for c in cols]), 256), 1, n)
