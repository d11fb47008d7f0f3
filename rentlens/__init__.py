"""rentlens: a Spark-native engine for rental-listing market analytics.

Sub-packages:
  sources    table readers, fixture projections, dimension tables, table store
  functions  Column -> Column scalar functions (text parsing, geo, JSON)
  operators  DataFrame -> DataFrame operators (dedup/merge, priors, features,
             deals, scorecards, rollups, history, model training)
  plans      the registered query plans and their SQL oracles
  streaming  Structured Streaming twins of the incremental ingest
"""

__version__ = "0.1.0"
