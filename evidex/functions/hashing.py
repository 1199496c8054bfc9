"""Content hashes and content-addressed names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: per-request noise of one source's pages ---------------------------------------
PAGE_NOISE = (
    r'window\.bodl\s*=\s*JSON\.parse\(decodeBase64\("[^"]*"\)\)',
    r"window\.__CF\$cv\$params\s*=\s*\{[^}]*\}",
    r'"(?:timestamp|visit_id|session_id|event_id)"\s*:\s*"[^"]*"',
)


def canonical(body: Column, noise: Sequence[str]) -> Column:
    """The body without its per-request noise; only hashes see this form."""
    for pattern in noise:
        body = F.regexp_replace(body, pattern, "")
    return body


def content_hash(body: Column, noise: Sequence[str] = ()) -> Column:
    return F.sha2(canonical(body, noise), 256)


def storage_key(sha: Column) -> Column:
    """``p/ab/<sha>.jpg``: the first two digits spread objects over folders."""
    return F.concat(F.lit("p/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(".jpg"))
