"""Quotation verification over tables, expressed as Spark DataFrame jobs."""
