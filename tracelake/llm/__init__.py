"""Training-data operators: ten operators over documents, pages and conversations.

Nothing outside this package (but ``corpus_pipeline.py`` and the guarded import
in ``__spark_entry__.py``) imports it.
"""
