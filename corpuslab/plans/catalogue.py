"""All named queries: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from corpuslab.plans import corpus, models

NAMES = {
    corpus: """
        corpus_lines union_corpora clean_general clean_strict clean_letters drop_blank
        positional_split prepared_corpus tokenize_char tokenize_space tokenize_word
        words_per_sequence token_counts word_counts top_words topk_words topk_overlap
        length_histogram length_summary corpus_stats prompts prompts_in_vocab run_grid
        build_vocab encode decode global_position
    """.split(),
    models: """
        wrap_sequences block_truncate block_byte_pairs block_longest_match next_token_pairs slice_corpus random_subsequences
        sequential_batches random_subsequences_part sequential_batches_part length_batches pad_batches causal_labels bigram_counts
        next_token_top2 score_tokens perplexity experiment_summary experiment_curve
        experiment_best experiment_learned generate_greedy
        generate_sampled probe_prompts nearest_original similarity_by_run bpe_train
        bpe_encode bpe_decode subword_longest_match
    """.split(),
}

QUERIES = {name: getattr(module, name) for module, names in NAMES.items() for name in names}
