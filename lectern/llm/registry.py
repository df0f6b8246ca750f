"""The numbered queries by name; SQL where SQL can express them."""

from __future__ import annotations

from .audit import OP12_SQL, op12_audit
from .bpe import op4_bpe
from .fingerprints import op1_fingerprints
from .forest import OP13_SQL, op13_forest
from .language import op3_language
from .packing import op10_packing
from .pages import op5_html
from .periodic import op11_runs
from .pii import op7_pii
from .quality import op8_quality
from .simhash import op2_simhash
from .substrings import op6_suffix_array
from .toxicity import op9_toxicity

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op4_bpe": op4_bpe,
    "op3_language": op3_language,
    "op5_html": op5_html,
    "op6_suffix_array": op6_suffix_array,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_runs": op11_runs,
    "op12_audit": op12_audit,
    "op13_forest": op13_forest,
}
ORACLES: dict[str, str] = {"op12_audit": OP12_SQL, "op13_forest": OP13_SQL}
