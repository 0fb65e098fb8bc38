"""Reporting operators for customer-contact cases, as lazily evaluated Spark DataFrames."""
