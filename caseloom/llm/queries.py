"""Registered queries of the training-data operators, one each, and their SQL where SQL can express them."""

from __future__ import annotations

from caseloom.llm.ann import op10_nearest_neighbours
from caseloom.llm.chat import OP3_SQL, op3_chat_formatting
from caseloom.llm.decontaminate import op1_benchmark_decontamination
from caseloom.llm.fingerprint import op12_document_fingerprints
from caseloom.llm.mixing import op2_source_mixing
from caseloom.llm.ngram_join import op5_ngram_jaccard_join
from caseloom.llm.prefix_trie import OP11_SQL, op11_conversation_trie
from caseloom.llm.quality import op6_quality_classifier
from caseloom.llm.secrets import op9_secret_scan
from caseloom.llm.substring_dedup import op4_substring_dedup
from caseloom.llm.toxicity import op7_toxicity
from caseloom.llm.warc import OP8_SQL, op8_warc
from caseloom.llm.whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_source_mixing, op3_chat_formatting, op4_substring_dedup, op5_ngram_jaccard_join,
        op6_quality_classifier, op7_toxicity, op8_warc, op9_secret_scan, op10_nearest_neighbours, op11_conversation_trie, op12_document_fingerprints,
        op13_embedding_whitening,
    )
}
ORACLE = {"op3_chat_formatting": OP3_SQL, "op8_warc": OP8_SQL, "op11_conversation_trie": OP11_SQL}
