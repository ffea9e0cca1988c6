"""arrearscope: receivables-portfolio analytics expressed as Spark DataFrame plans.

Layout:
  sources/    readers and writers (driver tables -> account portfolio, policy docs, JSON, CSV, models)
  functions/  column-expression rules (features, scorecards, bands, actions, formats)
  operators/  DataFrame -> DataFrame operators (validation, reports, compliance, bandit, retrieval,
              messages, splits, models, segments)
  plans/      composed end-to-end queries and the registry used by __spark_entry__.py
  streaming/  Structured Streaming twins of the batch operators
"""

__version__ = "0.1.0"
