"""ravelin: retrieval and knowledge-graph analytics expressed as Spark DataFrames."""
