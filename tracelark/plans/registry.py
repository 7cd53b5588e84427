"""All queries of the core and their SQL."""

from tracelark.plans import analysis, audit, corpus, dealt

QUERIES = {**corpus.QUERIES, **analysis.QUERIES, **audit.QUERIES, **dealt.QUERIES}
ORACLES = {**corpus.ORACLES, **analysis.ORACLES, **audit.ORACLES, **dealt.ORACLES}
