"""Training-data operators: language ID, nearest neighbours, decontamination,
token counts, mixing, HTML extraction, chat formatting, PII surrogates,
language-model scoring, the n-gram Jaccard join, fill-in-the-middle, the filter audit
and exact duplicates.

Nothing outside this subpackage imports it, except the guarded registration in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
