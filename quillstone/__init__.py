"""Document-text analytics on PySpark.

Text repair, keyword classification, key-field extraction, page and word
roll-ups, per-user history, language identification and exports, each written
as a ``DataFrame -> DataFrame`` operator over native Column expressions.
"""
