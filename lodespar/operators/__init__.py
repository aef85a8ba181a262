"""Relational operators: what plans are made of, as functions from DataFrames to DataFrames."""

from .aggregate import aggregate, expand, group_id, mark_distinct, partial_state, streaming_aggregate
from .basic import assign_unique_id, callback_sink, enforce_single_row, filter_rows, limit, local_partition, order_by, parallel_project, partitioned_output, project, row_number, scale_writers, sorted_merge, top_n, top_n_row_number, unnest, values
from .joins import as_of_join, cross_join, hash_join, index_lookup_join, merge_join, nested_loop_join, range_join
from .sets import except_all, except_distinct, intersect_all, intersect_distinct, union_all, union_distinct
from .spatial import spatial_join
from .window import column_frame, ntile_by, offset_by, window

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("aggregate_", "basic", "joins", "sets")]
