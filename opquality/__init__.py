"""Operator-quality analytics expressed as Spark DataFrame plans.

``functions``  Column -> Column helpers (ids, codes, dates, ratios, text)
``sources``    readers, writers, column resolution, profiling, sample inputs
``operators``  reusable DataFrame -> DataFrame building blocks
``plans``      the published tables and the reports built on them
"""
