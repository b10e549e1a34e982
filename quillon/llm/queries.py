"""The queries of this subpackage and their SQL, by name; __spark_entry__ adds them to its own."""

from __future__ import annotations

import importlib

#: name -> (module, SQL's name in it, None where SQL cannot express the query)
QUERIES = {
    "op1_decontaminate": ("decontaminate", "OP1_SQL"),
    "op2_media": ("media", None),
    "op3_language_id": ("langid", None),
    "op4_license_scan": ("licenses", None),
    "op5_minhash_dedup": ("minhash", "OP5_SQL"),
    "op6_substring_dedup": ("substring", "OP6_SQL"),
    "op7_suffix_array_dedup": ("suffixes", "OP7_SQL"),
    "op8_pitman_yor": ("pitmanyor", None),
    "op9_mixing": ("mixing", "OP9_SQL"),
    "op10_quality": ("quality", None),
    "op11_periodic_runs": ("periodic", None),
    "op12_whitening": ("whitening", None),
    "op13_html_text": ("htmltext", None),
}


def _module(name: str):
    return importlib.import_module(f"quillon.llm.{QUERIES[name][0]}")


def queries() -> dict:
    return {n: getattr(_module(n), n) for n in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {n: getattr(_module(n), sql) for n, (_, sql) in QUERIES.items() if sql}
