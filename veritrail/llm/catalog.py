"""The package's queries for ``__spark_entry__``, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrail.llm import divergence, fingerprints, html_text, infill, language_id, mixing, near_dup, oracles, packing, quality, repeats, token_store, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality": quality.op1_line_quality,
    "op2_language_id": language_id.op2_language_id,
    "op3_suffix_array_dedup": repeats.op3_suffix_array_dedup,
    "op4_minhash_near_dup": near_dup.op4_minhash_near_dup,
    "op5_warc_derivatives": warc.op5_warc_derivatives,
    "op6_token_store": token_store.op6_token_store,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_simhash": fingerprints.op9_simhash,
    "op10_curriculum_mix": mixing.op10_curriculum_mix,
    "op11_embedding_range_join": vectors.op11_embedding_range_join,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op1_line_quality": oracles.LINE_QUALITY,
    "op11_embedding_range_join": oracles.RANGE_JOIN,
    "op12_fill_in_middle": oracles.INFILL,
    "op13_source_divergence": oracles.DIVERGENCE,
}
