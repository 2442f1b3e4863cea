"""The queries of this subpackage and their SQL."""

from . import url_filters
from .decontaminate import op5_benchmark_decontamination
from .embedding_links import op9_embedding_near_dedup
from .language import op6_language_id
from .packing import op4_best_fit_packing
from .quality import op3_quality_classifier
from .secrets_scan import op7_secret_scans
from .simhash import op1_simhash_near_dedup
from .token_counts import op10_token_counts
from .toxicity import op8_toxicity
from .url_filters import op2_url_filters

QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_url_filters, op3_quality_classifier, op4_best_fit_packing, op5_benchmark_decontamination, op6_language_id, op7_secret_scans, op8_toxicity, op9_embedding_near_dedup, op10_token_counts)}
#: Only the rules and links can be put in SQL; the other operators are tested against brute force.
ORACLES: dict[str, str] = {"op2_url_filters": url_filters.oracle()}
