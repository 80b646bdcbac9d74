"""The queries of the text operators, one each over its whole table, and the pipeline."""

from __future__ import annotations

from . import bpe, compaction, exact, licenses, minhash, mixing, pii, quality, tiff, unigram
from .oracles import ORACLES

QUERIES = {
    f.__name__: f
    for f in (
        minhash.op1_minhash_dedup,
        licenses.op2_license_scan,
        tiff.op3_tiff_pages,
        bpe.op4_bpe_round_trip,
        mixing.op5_sainte_lague_mix,
        pii.op6_feistel_pseudonyms,
        quality.op7_kneser_ney_quality,
        unigram.op8_unigram_token_counts,
        exact.op9_exact_fingerprint,
        compaction.op10_size_tiered_shards,
    )
}

__all__ = ["ORACLES", "QUERIES"]
