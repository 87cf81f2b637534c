"""Training-data operators: dedup, joins, packing, tokenising, language, privacy and quality.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames;
``queries.py`` binds them to the synthetic tables.
"""
