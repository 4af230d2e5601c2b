"""The queries of this package and their SQL counterparts."""

from . import bpe, digest_index, fm_index, hard_negatives, hilbert, language, lexical, mixing, order_minhash, quality, suffix_levels, toxicity, url_filters

_MODULES = (language, url_filters, fm_index, hilbert, suffix_levels, bpe, order_minhash, quality, mixing, toxicity, hard_negatives, digest_index, lexical)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
