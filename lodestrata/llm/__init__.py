"""Training-data operators: sharding, deduplication, decontamination, tokenisation,
language identification, search, token counts, secret scans, scoring and toxicity.

Nothing outside this subpackage imports it, apart from the guarded hook in ``__spark_entry__``.
"""
