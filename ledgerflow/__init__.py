"""ledgerflow — ledger and voucher analytics as Spark DataFrame jobs.

Layout:
  functions/  Column -> Column expressions (normalisation, coercion, dates, display)
  sources/    table bindings, dirty-XML ingest, snapshot sinks
  operators/  filters, joins (name resolution), windows, aggregates, reports
  plans/      question batches: routing, parameter extraction, answering
  streaming/  snapshot refresh with Structured Streaming
"""

from ledgerflow.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
