"""Feature levels of a field index, and the schemas of its relations."""

from __future__ import annotations

from enum import IntEnum

OCCURRENCES = "field string, doc_id long, pos int, token string"
POSTINGS = "field string, token string, doc_id long, tf long, positions array<int>"
TOKEN_STATS = "field string, token string, doc_frequency long, term_frequency long, single_docid long"
DOC_STATS = "field string, doc_id long, doc_len long"
LINE_DOCS = "title string, body string, random_label string, time_of_day_secs int, timestamp_ms long"

#: Entries of a posting block.
BLOCK = 256


class Features(IntEnum):
    """What a field keeps of each token: the documents, also its frequency in each, also its positions."""

    DOC = 0
    TERM_FREQUENCY = 1
    POSITIONS = 2

    @property
    def has_term_frequency(self) -> bool:
        return self >= Features.TERM_FREQUENCY

    @property
    def has_positions(self) -> bool:
        return self >= Features.POSITIONS
