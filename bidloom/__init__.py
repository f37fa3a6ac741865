"""Document-quotation analytics on Spark."""
