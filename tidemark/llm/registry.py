"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm.bpe import op6_bpe
from tidemark.llm.conversations import OP11_SQL, op11_conversation_repair
from tidemark.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from tidemark.llm.fingerprints import op10_fingerprints
from tidemark.llm.jaccard import op5_jaccard
from tidemark.llm.license_scan import op1_license_scan
from tidemark.llm.line_dedup import OP13_SQL, op13_line_dedup
from tidemark.llm.lm import op7_lm_score
from tidemark.llm.packing import op8_packing
from tidemark.llm.quality import op3_quality
from tidemark.llm.sharding import op9_sharding
from tidemark.llm.url_filter import OP2_SQL, op2_url_filter
from tidemark.llm.whitening import op12_whitening

_FUNCTIONS = (
    op1_license_scan, op2_url_filter, op3_quality, op4_exact_dedup, op5_jaccard, op6_bpe, op7_lm_score, op8_packing, op9_sharding, op10_fingerprints,
    op11_conversation_repair, op12_whitening, op13_line_dedup,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {"op2_url_filter": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op11_conversation_repair": OP11_SQL, "op13_line_dedup": OP13_SQL}
