"""Queries of this package's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.audit import op12_filter_interaction
from strandlake.llm.audit import oracle_sql as audit_sql
from strandlake.llm.embedding_join import op9_embedding_range_join
from strandlake.llm.html_text import op4_page_differencing
from strandlake.llm.media import op3_avi_motion_jpeg
from strandlake.llm.packing import op10_sum_of_squares_packing
from strandlake.llm.pieces import op8_shared_prefix_viterbi
from strandlake.llm.relative_lz import op2_relative_lempel_ziv
from strandlake.llm.sharding import op5_lookup_sharding
from strandlake.llm.sharding import oracle_sql as sharding_sql
from strandlake.llm.simhash import op7_simhash_pigeonring
from strandlake.llm.spelling import op11_symmetric_delete
from strandlake.llm.spelling import oracle_sql as spelling_sql
from strandlake.llm.suffix_dedup import op6_suffix_array_dedup
from strandlake.llm.toxicity import op1_toxic_segments
from strandlake.llm.warc import op13_warc_index_first
from strandlake.llm.warc import oracle_sql as warc_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxic_segments": op1_toxic_segments,
    "op2_relative_lempel_ziv": op2_relative_lempel_ziv,
    "op3_avi_motion_jpeg": op3_avi_motion_jpeg,
    "op4_page_differencing": op4_page_differencing,
    "op5_lookup_sharding": op5_lookup_sharding,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_simhash_pigeonring": op7_simhash_pigeonring,
    "op8_shared_prefix_viterbi": op8_shared_prefix_viterbi,
    "op9_embedding_range_join": op9_embedding_range_join,
    "op10_sum_of_squares_packing": op10_sum_of_squares_packing,
    "op11_symmetric_delete": op11_symmetric_delete,
    "op12_filter_interaction": op12_filter_interaction,
    "op13_warc_index_first": op13_warc_index_first,
}

ORACLE_SQL: dict[str, str] = {
    "op5_lookup_sharding": sharding_sql(),
    "op11_symmetric_delete": spelling_sql(),
    "op12_filter_interaction": audit_sql(),
    "op13_warc_index_first": warc_sql(),
}
