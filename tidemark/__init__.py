"""Timed-text analytics on Spark: words, speaker turns, pauses and tracks of many recordings as DataFrames.

Every table has ``rec_id``, the recording; windows and joins are keyed by it, so recordings are spread over the
cluster and none needs another. Times are seconds, spans half-open.
"""
