"""The queries of this package and their SQL."""

from __future__ import annotations

from . import byte_bpe, filter_audit, flac, jaccard, language, packing, quality, repeats, search, sharding, token_files, url_lists, vectors

_MODULES = (flac, sharding, token_files, url_lists, jaccard, repeats, quality, packing, language, byte_bpe, search, vectors, filter_audit)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
