"""Queries of this subpackage, by registered name, and the SQL that some of them equal."""

from __future__ import annotations

from . import decontaminate, html, langid, licenses, lines, manifest, media, negatives, packing, secrets, sharding, simhash, urls

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_simhash": simhash.op2_simhash,
    "op3_media": media.op3_media,
    "op4_packing": packing.op4_packing,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_secrets": secrets.op6_secrets,
    "op7_sharding": sharding.op7_sharding,
    "op8_langid": langid.op8_langid,
    "op9_urls": urls.op9_urls,
    "op10_html": html.op10_html,
    "op11_merkle": manifest.op11_merkle,
    "op12_lines": lines.op12_lines,
    "op13_negatives": negatives.op13_negatives,
}

ORACLES = {
    "op5_decontaminate": decontaminate.ORACLE,
    "op7_sharding": sharding.oracle(),
    "op9_urls": urls.ORACLE,
    "op11_merkle": manifest.ORACLE,
    "op12_lines": lines.ORACLE,
    "op13_negatives": negatives.ORACLE,
}
