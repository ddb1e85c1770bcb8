"""Queries of the corpus operators and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from sifter.llm.bpe import op10_bpe
from sifter.llm.covertree import ORACLE_OP2, op2_covertree
from sifter.llm.decontaminate import ORACLE_OP9, op9_decontaminate
from sifter.llm.htmltext import op8_html_text
from sifter.llm.langid import op6_language_id
from sifter.llm.merkle import ORACLE_OP13, op13_merkle
from sifter.llm.pii import op5_pii
from sifter.llm.simhash import op1_simhash
from sifter.llm.tokenfile import op12_token_blocks
from sifter.llm.toxicity import op4_toxicity
from sifter.llm.urls import op3_url_filter
from sifter.llm.warc import ORACLE_OP7, op7_warc
from sifter.llm.whitening import op11_whitening

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_covertree": op2_covertree,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_html_text": op8_html_text,
    "op9_decontaminate": op9_decontaminate,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_token_blocks": op12_token_blocks,
    "op13_merkle": op13_merkle,
}

ORACLE: dict[str, str] = {
    "op2_covertree": ORACLE_OP2,
    "op7_warc": ORACLE_OP7,
    "op9_decontaminate": ORACLE_OP9,
    "op13_merkle": ORACLE_OP13,
}
