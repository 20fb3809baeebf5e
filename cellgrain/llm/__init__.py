"""Operators for training-data pipelines. Importing the package registers their queries."""

from cellgrain.llm import (  # noqa: F401
    chat, collocations, decontamination, lexical_search, line_dedup, near_dedup, piece_lattice, quality, sharding, substring_dedup,
    token_counts, url_filter, warc,
)
from cellgrain.llm.common import ORACLES, QUERIES  # noqa: F401
