"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from flowpane.llm import collocations, lexical, mixing, top_k
from flowpane.llm.byte_bpe import op7_byte_bpe
from flowpane.llm.collocations import op12_collocations
from flowpane.llm.fertility import op5_fertility
from flowpane.llm.language_model import op11_lm_scores
from flowpane.llm.lexical import op13_lexical_search
from flowpane.llm.mixing import op6_mixing
from flowpane.llm.personal_data import op10_personal_data
from flowpane.llm.repeats import op9_repeats
from flowpane.llm.simhash import op8_simhash
from flowpane.llm.token_counts import op4_token_counts
from flowpane.llm.token_files import op1_token_files
from flowpane.llm.top_k import op3_top_k
from flowpane.llm.toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_token_files, op2_toxicity, op3_top_k, op4_token_counts, op5_fertility, op6_mixing, op7_byte_bpe, op8_simhash, op9_repeats, op10_personal_data, op11_lm_scores, op12_collocations, op13_lexical_search)}
ORACLE_SQL = {"op12_collocations": collocations.SQL, "op3_top_k": top_k.SQL, "op6_mixing": mixing.SQL, "op13_lexical_search": lexical.SQL}
