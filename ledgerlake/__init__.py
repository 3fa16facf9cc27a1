"""Filing analytics as Spark jobs: facts, metrics, retrieval and verification over many filings at once."""
