"""The opN queries and their SQL."""

from __future__ import annotations

from . import ann, bpe, factors, lexical, lm, mixing, simhash, suffix, topk, toxicity, turns, urls, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ann": ann.op2_ann,
    "ann_recall": ann.ann_recall,
    "op3_warc": warc.op3_warc,
    "op4_simhash": simhash.op4_simhash,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_ngram_lm": lm.op6_ngram_lm,
    "op7_url_filter": urls.op7_url_filter,
    "op8_bm25": topk.op8_bm25,
    "op9_mixing": mixing.op9_mixing,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
    "op11_turn_repair": turns.op11_turn_repair,
    "op12_passages": factors.op12_passages,
    "op13_lexical": lexical.op13_lexical,
}
ORACLE: dict[str, str] = {"op3_warc": warc.OP3_SQL, "op7_url_filter": urls.OP7_SQL, "op8_bm25": topk.OP8_SQL, "op9_mixing": mixing.OP9_SQL, "op11_turn_repair": turns.OP11_SQL, "op13_lexical": lexical.OP13_SQL}
