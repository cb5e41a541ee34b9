"""The queries of the corpus operators, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from quarry.llm import alignment, bytestrings, fingerprints, jaccard, langid, licences, mixing, packing, quality, rules, substrings, variants, warc


def queries():
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_license_scan": licences.op4_license_scan,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_quality_rules": rules.op6_quality_rules,
        "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
        "op8_suffix_dedup": bytestrings.op8_suffix_dedup,
        "op9_quality_knn": quality.op9_quality_knn,
        "op10_language_id": langid.op10_language_id,
        "op11_warc_archive": warc.op11_warc_archive,
        "op12_spelling_variants": variants.op12_spelling_variants,
        "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
    }


def oracle_sql():
    return {"op1_mix_sources": mixing.op1_sql(), "op11_warc_archive": warc.op11_sql()}
