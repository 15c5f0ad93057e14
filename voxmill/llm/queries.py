"""The queries of this subpackage, by name, and SQL for those that it can express."""

from __future__ import annotations

from voxmill.llm.bpe import op4_byte_bpe
from voxmill.llm.elias_fano import op10_elias_fano_output
from voxmill.llm.html import op3_html_extraction
from voxmill.llm.licenses import OP8_SQL, op8_license_scan
from voxmill.llm.merkle import OP2_SQL, op2_merkle_fingerprints
from voxmill.llm.neardup import OP6_SQL, op6_near_duplicates
from voxmill.llm.packing import op9_best_fit_packing
from voxmill.llm.pii import op7_pii
from voxmill.llm.quality import op5_quality_classifier
from voxmill.llm.topk import OP1_SQL, op1_exact_top_k

QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_merkle_fingerprints": op2_merkle_fingerprints,
    "op3_html_extraction": op3_html_extraction,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_pii": op7_pii,
    "op8_license_scan": op8_license_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_elias_fano_output": op10_elias_fano_output,
}
SQL = {"op1_exact_top_k": OP1_SQL, "op2_merkle_fingerprints": OP2_SQL, "op6_near_duplicates": OP6_SQL, "op8_license_scan": OP8_SQL}
