"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from cadenza.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from cadenza.llm.html_extract import op9_html_extract
from cadenza.llm.jaccard_join import OP10_SQL, op10_jaccard_join
from cadenza.llm.knn_join import OP11_SQL, op11_knn_join
from cadenza.llm.language_id import op7_language_id
from cadenza.llm.mixing import OP1_SQL, op1_mix_sources
from cadenza.llm.nearest import op4_nearest
from cadenza.llm.packing import op3_pack_sequences
from cadenza.llm.quality import op8_quality
from cadenza.llm.secrets import op2_secret_scan
from cadenza.llm.spelling import OP12_SQL, op12_spelling_variants
from cadenza.llm.substring_dedup import op6_substring_dedup
from cadenza.llm.whitening import op13_whiten

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_secret_scan, op3_pack_sequences, op4_nearest, op5_exact_dedup, op6_substring_dedup, op7_language_id, op8_quality, op9_html_extract, op10_jaccard_join, op11_knn_join, op12_spelling_variants, op13_whiten)}

ORACLES = {"op1_mix_sources": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op10_jaccard_join": OP10_SQL, "op11_knn_join": OP11_SQL, "op12_spelling_variants": OP12_SQL}
