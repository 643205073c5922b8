"""All queries by name."""

from __future__ import annotations

from checks import answers, classification, generated, ingest, roundtrips, search, streams

ALL: dict = {
    **classification.QUERIES,
    **ingest.QUERIES,
    **search.QUERIES,
    **answers.QUERIES,
    **generated.QUERIES,
    **streams.QUERIES,
    **roundtrips.QUERIES,
}
