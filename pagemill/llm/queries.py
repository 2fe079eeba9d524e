"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import conversations, decontaminate, licenses, nearest, packing, quality, quotes, secrets, sharding, simhash, toxicity, urls, whitening

QUERIES = {
    "op1_quotes": quotes.query,
    "op2_decontaminate": decontaminate.query,
    "op3_urls": urls.query,
    "op4_toxicity": toxicity.query,
    "op5_nearest": nearest.query,
    "op6_packing": packing.query,
    "op7_sharding": sharding.query,
    "op8_simhash": simhash.query,
    "op9_secrets": secrets.query,
    "op10_licenses": licenses.query,
    "op11_quality": quality.query,
    "op12_whitening": whitening.query,
    "op13_conversations": conversations.query,
}
ORACLES = {"op1_quotes": quotes.ORACLE, "op2_decontaminate": decontaminate.ORACLE, "op3_urls": urls.ORACLE, "op11_quality": quality.ORACLE, "op13_conversations": conversations.ORACLE}
