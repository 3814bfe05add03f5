"""Spark operators for bilingual text collections and the ledgers of the jobs that produce them."""
