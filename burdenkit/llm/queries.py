"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from .ann_hilbert import op1_nearest_neighbours
from .exact import OP10_SQL, op10_exact_dedup
from .filter_audit import OP13_SQL, op13_filter_audit
from .histogram_packing import op11_histogram_packing
from .langid import op8_language_id
from .lines import OP7_SQL, op7_line_dedup
from .mixing import op6_source_mix
from .packing import op5_best_fit_packing
from .quality_crf import op2_quality_classifier
from .secrets import op3_secret_scan
from .simhash import op9_simhash_near_dedup
from .spelling import op12_spelling_variants
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_quality_classifier, op3_secret_scan, op4_toxicity, op5_best_fit_packing, op6_source_mix, op7_line_dedup, op8_language_id, op9_simhash_near_dedup, op10_exact_dedup, op11_histogram_packing, op12_spelling_variants, op13_filter_audit)}
ORACLES = {"op7_line_dedup": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op13_filter_audit": OP13_SQL}
