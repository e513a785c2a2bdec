"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from inputtrace.llm.bpe import op6_transducer_bpe
from inputtrace.llm.decontaminate import op1_template_decontamination
from inputtrace.llm.exact_dedup import OP5_SQL, op5_digest_index
from inputtrace.llm.html_text import op7_tree_scoring
from inputtrace.llm.infill import OP11_SQL, op11_piece_table_infill
from inputtrace.llm.language_id import op8_rank_order_profiles
from inputtrace.llm.line_dedup import OP10_SQL, op10_levelled_line_runs
from inputtrace.llm.negatives import OP13_SQL, op13_cover_tree_negatives
from inputtrace.llm.quality import op9_compression_quality
from inputtrace.llm.repair import op2_repair_ids
from inputtrace.llm.secrets import op12_entropy_secrets
from inputtrace.llm.simhash import op4_pivot_simhash
from inputtrace.llm.substring import OP3_SQL, op3_seed_extend_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_template_decontamination, op2_repair_ids, op3_seed_extend_dedup, op4_pivot_simhash, op5_digest_index, op6_transducer_bpe, op7_tree_scoring, op8_rank_order_profiles, op9_compression_quality, op10_levelled_line_runs,
        op11_piece_table_infill, op12_entropy_secrets, op13_cover_tree_negatives,
    )
}
ORACLES = {"op3_seed_extend_dedup": OP3_SQL, "op5_digest_index": OP5_SQL, "op10_levelled_line_runs": OP10_SQL, "op11_piece_table_infill": OP11_SQL, "op13_cover_tree_negatives": OP13_SQL}
