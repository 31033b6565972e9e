"""sitelume: a Spark-first analytics engine for crawled web sites."""
