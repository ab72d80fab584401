"""The queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from rasterloom.llm.best_fit import op10_best_fit_packing
from rasterloom.llm.exact_topk import OP6_SQL, op6_exact_topk
from rasterloom.llm.grammar_ids import op9_grammar_ids
from rasterloom.llm.jaccard_join import OP1_SQL, op1_ngram_jaccard
from rasterloom.llm.language_id import op8_language_id
from rasterloom.llm.secrets import OP2_SQL, op2_secret_scan
from rasterloom.llm.source_mix import op4_source_mix
from rasterloom.llm.token_counts import op3_token_counts
from rasterloom.llm.vector_dedup import OP5_SQL, op5_vector_near_dups
from rasterloom.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    q.__name__: q
    for q in (op1_ngram_jaccard, op2_secret_scan, op3_token_counts, op4_source_mix, op5_vector_near_dups, op6_exact_topk, op7_warc, op8_language_id, op9_grammar_ids, op10_best_fit_packing)
}
ORACLES = {"op1_ngram_jaccard": OP1_SQL, "op2_secret_scan": OP2_SQL, "op5_vector_near_dups": OP5_SQL, "op6_exact_topk": OP6_SQL, "op7_warc": OP7_SQL}
