"""Streaming.

The reference processes files in batch only: no stream source, watermark,
window or stateful operator exists in it, so nothing is built here.  Every
operator in ``featloom.operators`` is a DataFrame function made of built-in
expressions; the per-period aggregates (``groupBy`` + sums/counts) also run
unchanged on a streaming DataFrame inside ``foreachBatch``.
"""
