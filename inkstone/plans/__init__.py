"""Decoding plans: an in-memory kernel for UDFs and a relational plan over DataFrames."""
