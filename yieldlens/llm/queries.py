"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import alignment, bytebpe, centroids, decontam, fingerprint, huffman, langid, licenses, minhash, sharding, suffixdedup, urlfilter, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_sharding": sharding.op2_sharding,
    "op3_warc": warc.op3_warc,
    "op4_token_output": huffman.op4_token_output,
    "op5_fingerprint": fingerprint.op5_fingerprint,
    "op6_suffix_dedup": suffixdedup.op6_suffix_dedup,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_minhash": minhash.op9_minhash,
    "op10_byte_bpe": bytebpe.op10_byte_bpe,
    "op11_alignment": alignment.op11_alignment,
    "op12_centroids": centroids.op12_centroids,
    "op13_url_filter": urlfilter.op13_url_filter,
}

ORACLE = {"op2_sharding": sharding.OP2_SQL, "op3_warc": warc.OP3_SQL, "op8_license_scan": licenses.OP8_SQL, "op12_centroids": centroids.OP12_SQL, "op13_url_filter": urlfilter.OP13_SQL}
