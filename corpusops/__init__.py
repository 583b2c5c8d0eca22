"""corpusops: knowledge-base ingest, hybrid search, retrieval evaluation, reports
and rule-source analysis as DataFrame jobs on Spark."""
