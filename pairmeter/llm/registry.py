"""Name -> query and name -> DuckDB twin of the corpus operators."""

from pairmeter.llm import collocations, divergence, fingerprint, html_text, jaccard, langid, mixing, packing, piece_codec, pii, quality, vectors, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_vector_near_dedup": vectors.query,
    "op3_jaccard_join": jaccard.query,
    "op4_language": langid.query,
    "op5_quality": quality.query,
    "op6_fingerprint": fingerprint.query,
    "op7_packing": packing.query,
    "op8_html_text": html_text.query,
    "op9_pii": pii.query,
    "op10_warc": warc.query,
    "op11_divergence": divergence.query,
    "op12_sentencepiece": piece_codec.query,
    "op13_collocations": collocations.query,
}

ORACLES = {
    "op1_mixing": mixing.SQL,
    "op2_vector_near_dedup": vectors.SQL,
    "op3_jaccard_join": jaccard.SQL,
    "op10_warc": warc.SQL,
    "op11_divergence": divergence.SQL,
    "op13_collocations": collocations.SQL,
}
