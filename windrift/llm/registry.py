"""The queries of the training-data operators and their SQL."""

from . import bpe, decontam, langid, negatives, pii, quality, repair, simhash, suffixes, syncmers, token_counts, token_files, urls

_MODULES = [token_files, decontam, quality, urls, syncmers, simhash, suffixes, pii, bpe, langid, negatives, repair, token_counts]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
