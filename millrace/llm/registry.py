"""All queries of the corpus operators and their oracle SQL."""

from millrace.llm import decontaminate, jaccard, licenses, packing, pii, quality, secrets, sharding, suffixes, tokens

_MODULES = (packing, jaccard, licenses, decontaminate, pii, tokens, quality, sharding, secrets, suffixes)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
