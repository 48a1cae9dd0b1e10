"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from . import embedding_dedup, exact_dedup, fingerprints, html_extract, jaccard_join, license_scan, merkle, nbest, packing, prefix_trie, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_sentencepiece_n_best": nbest.op3_sentencepiece_n_best,
    "op4_suffix_array_dedup": substring_dedup.op4_suffix_array_dedup,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_prefix_fingerprints": fingerprints.op6_prefix_fingerprints,
    "op7_toxicity_cnn": toxicity.op7_toxicity_cnn,
    "op8_html_crf": html_extract.op8_html_crf,
    "op9_sum_of_squares_packing": packing.op9_sum_of_squares_packing,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_embedding_near_dedup": embedding_dedup.op13_embedding_near_dedup,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_url_filter": url_filter.oracle(),
    "op4_suffix_array_dedup": substring_dedup.ORACLE,
    "op5_ngram_jaccard_join": jaccard_join.ORACLE,
    "op10_license_scan": license_scan.oracle(),
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_embedding_near_dedup": embedding_dedup.ORACLE,
}
