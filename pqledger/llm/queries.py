"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op3_benchmark_decontamination
from .html import op4_html_extraction
from .language import op8_language_id
from .importance import ORACLE as IMPORTANCE_ORACLE
from .importance import op11_importance_resampling
from .lm import op10_lm_scoring
from .mixing import op5_mixing
from .neardup import op6_minhash_near_dedup
from .negatives import ORACLE as NEGATIVES_ORACLE
from .negatives import op13_hard_negatives
from .pieces import op12_sentencepiece
from .quality import ORACLE as QUALITY_ORACLE
from .quality import op1_quality_rules
from .substring import op7_substring_dedup
from .tokens import op2_token_binary
from .toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_token_binary, op3_benchmark_decontamination, op4_html_extraction, op5_mixing, op6_minhash_near_dedup, op7_substring_dedup, op8_language_id, op9_toxicity, op10_lm_scoring, op11_importance_resampling, op12_sentencepiece, op13_hard_negatives)
}
ORACLES = {**QUALITY_ORACLE, **IMPORTANCE_ORACLE, **NEGATIVES_ORACLE}
