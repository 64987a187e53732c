"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from tapeworks.llm.bpe import op10_byte_bpe
from tapeworks.llm.chat import op2_chat_formatting
from tapeworks.llm.classlm import op6_class_lm
from tapeworks.llm.decontaminate import op1_decontamination
from tapeworks.llm.langid import op8_language_id
from tapeworks.llm.linededup import OP4_SQL, op4_line_dedup
from tapeworks.llm.minhash import op7_near_duplicates
from tapeworks.llm.mixing import OP13_SQL, op13_source_mix
from tapeworks.llm.passages import op3_repeated_passages
from tapeworks.llm.pfor import op9_token_files
from tapeworks.llm.quality import OP5_SQL, op5_quality_rules
from tapeworks.llm.spelling import OP11_SQL, op11_spelling_variants
from tapeworks.llm.trie import OP12_SQL, op12_prefix_trie

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_chat_formatting,
        op3_repeated_passages,
        op4_line_dedup,
        op5_quality_rules,
        op6_class_lm,
        op7_near_duplicates,
        op8_language_id,
        op9_token_files,
        op10_byte_bpe,
        op11_spelling_variants,
        op12_prefix_trie,
        op13_source_mix,
    )
}

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op5_quality_rules": OP5_SQL, "op11_spelling_variants": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_source_mix": OP13_SQL}
