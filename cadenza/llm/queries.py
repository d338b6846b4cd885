"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import ORACLE as ORACLE_1
from .decontaminate import op1_winnowing_decontamination
from .divergence import ORACLE as ORACLE_12
from .divergence import op12_source_divergence
from .langid import op9_ftrl_language_id
from .licenses import ORACLE as ORACLE_3
from .licenses import op3_license_scan
from .ordermin import op8_order_minhash
from .pieces import op4_sentencepiece
from .quality import op2_ordinal_quality
from .rules import op5_decision_list
from .shards import op10_hilbert_shards
from .simhash import op13_simhash_pigeonhole
from .spans import op6_sentence_spans
from .structure import op11_dial_structure_repair
from .suffixes import ORACLE as ORACLE_7
from .suffixes import op7_external_suffix_sort

QUERIES = {
    "op1_winnowing_decontamination": op1_winnowing_decontamination,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decision_list": op5_decision_list,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_external_suffix_sort": op7_external_suffix_sort,
    "op8_order_minhash": op8_order_minhash,
    "op9_ftrl_language_id": op9_ftrl_language_id,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op11_dial_structure_repair": op11_dial_structure_repair,
    "op12_source_divergence": op12_source_divergence,
    "op13_simhash_pigeonhole": op13_simhash_pigeonhole,
}
ORACLE_SQL = {
    "op1_winnowing_decontamination": ORACLE_1,
    "op3_license_scan": ORACLE_3,
    "op7_external_suffix_sort": ORACLE_7,
    "op12_source_divergence": ORACLE_12,
}
