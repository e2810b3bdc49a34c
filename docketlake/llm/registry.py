"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline

from . import op7, op11, op12, op13
from .op1 import op1_token_counts
from .op2 import op2_mix
from .op3 import op3_bpe_roundtrip
from .op4 import op4_audio
from .op5 import op5_ngram_jaccard
from .op6 import op6_nearest
from .op7 import op7_lines
from .op8 import op8_quality
from .op9 import op9_pii
from .op10 import op10_spans
from .op11 import op11_near_vectors
from .op12 import op12_impact_search
from .op13 import op13_spelling

QUERIES: dict = {
    "pipeline": corpus_pipeline.run,
    "op1_token_counts": op1_token_counts,
    "op2_mix": op2_mix,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_audio": op4_audio,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_nearest": op6_nearest,
    "op7_lines": op7_lines,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_spans": op10_spans,
    "op11_near_vectors": op11_near_vectors,
    "op12_impact_search": op12_impact_search,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {
    "op7_lines": op7.ORACLE,
    "op11_near_vectors": op11.ORACLE,
    "op12_impact_search": op12.ORACLE,
    "op13_spelling": op13.ORACLE,
}
