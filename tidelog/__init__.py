"""tidelog: versioned, ordered key-value tables on Spark, plus corpus operators in ``tidelog.llm``."""
