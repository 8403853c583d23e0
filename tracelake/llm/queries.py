"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP6_SQL, op6_chat_formatting
from .fingerprints import op7_document_fingerprints
from .html_text import op10_html_extraction
from .media import op9_media_columns
from .mixing import op8_mixing
from .near_dedup import op5_minhash_near_dedup
from .pieces import op1_sentencepiece
from .quality import op4_quality_classifier
from .secrets import op2_secret_scans
from .toxicity import op3_toxicity


def queries() -> dict:
    found = (op1_sentencepiece, op2_secret_scans, op3_toxicity, op4_quality_classifier, op5_minhash_near_dedup, op6_chat_formatting, op7_document_fingerprints, op8_mixing, op9_media_columns, op10_html_extraction)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": OP6_SQL}
