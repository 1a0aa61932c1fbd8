"""Names of the registered queries."""

from lanternrank.registry import queries as q

QUERIES = {
    f.__name__: f
    for f in (
        q.l2_normalize,
        q.cosine_pairs,
        q.sq_l2_cosine,
        q.float32_cast,
        q.knn_topk,
        q.knn_topk_blocked,
        q.knn_topk_1000,
        q.knn_skewed_groups,
        q.first_hit_hot_keys,
        q.text_search_topk,
        q.first_hit,
        q.first_hit_depth_20,
        q.first_hit_searched,
        q.mrr_curve,
        q.hit_curve,
        q.mrr_hard,
        q.search_report,
        q.average_precision_labels,
        q.map_in_domain,
        q.map_cross_domain,
        q.map_keep_self,
        q.suite_report,
        q.suite_display,
        q.code_suite,
        q.run_suite_files,
        q.run_code_suite_files,
        q.structural_pairs,
        q.structural_classes,
        q.annotated_pairs,
        q.pair_by_key,
        q.collapse_ws,
        q.join_tokens,
        q.drop_blank_lines,
        q.instruct,
        q.truncate_tokens,
        q.strip_c_comments,
        q.strip_c_comments_pages,
        q.strip_py_comments,
        q.strip_py_templates,
        q.strip_comments,
        q.fit_tokens,
        q.attention_mask,
        q.collate_csn,
        q.collate_csn_format,
        q.collate_cosqa_query,
        q.collate_cosqa_code,
        q.collate_cosqa_code_format,
        q.collate_advtest,
        q.collate_advtest_format,
        q.collate_code,
        q.embed_local,
        q.embed_query,
        q.embed_service,
        q.pool_last,
        q.pool_first,
        q.pool_mean,
        q.pick_first_layer,
        q.json_roundtrip,
        q.read_documents,
        q.read_arrays,
        q.read_code_labels,
        q.embedding_roundtrip,
        q.report_roundtrip,
        q.dataset_counts,
        q.embed_stream,
    )
}
