"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from parcelforge.llm import authored, encoding, language, match, packing, same_address, survivor

QUERIES = {
    "p1_found": same_address.p1_found,
    "p1_places": same_address.p1_places,
    "p2_found": survivor.p2_found,
    "p2_survivors": survivor.p2_survivors,
    "p3_found": match.p3_found,
    "p3_matches": match.p3_matches,
    "p6_found": authored.p6_found,
    "p6_texts": authored.p6_texts,
    "p8_ids": encoding.p8_ids,
    "p9_packing": packing.p9_packing,
    "p9_fill": packing.p9_fill,
    "p10_found": language.p10_found,
    "p10_documents": language.p10_documents,
}
ORACLE: dict[str, str] = {}
