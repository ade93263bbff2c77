"""Queries of this subpackage and their SQL. Where SQL can't express an operator, tests hold it against brute force."""

from __future__ import annotations

from parchmint.llm import languages, leaks, name_links, near_duplicates, packing, personal, residue, scan_noise


def queries() -> dict:
    return {
        "p1_found": near_duplicates.p1_found, "p1_groups": near_duplicates.p1_groups,
        "p2_found": personal.p2_found, "p2_redacted": personal.p2_redacted,
        "p3_found": languages.p3_found, "p3_pages": languages.p3_pages,
        "p4_found": name_links.p4_found,
        "p5_found": scan_noise.p5_found, "p5_paragraphs": scan_noise.p5_paragraphs,
        "p6_packed": packing.p6_packed, "p6_fill": packing.p6_fill,
        "p7_found": leaks.p7_found, "p7_items": leaks.p7_items,
        "p8_found": residue.p8_found, "p8_kinds": residue.p8_kinds,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": near_duplicates.P1_SQL,
        "p7_found": leaks.P7_SQL,
        "p7_items": f"SELECT item_id, count(*)::BIGINT AS documents FROM ({leaks.P7_SQL}) GROUP BY item_id",
    }
