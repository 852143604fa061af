"""The registered queries of this subpackage and what SQL there is for them."""

from __future__ import annotations

import importlib

#: query name: module that holds it
NAMES = {
    "op1_decontaminate": "op1_decontaminate",
    "op2_vafile": "op2_vafile",
    "op3_reshard": "op3_reshard",
    "op4_jaccard": "op4_jaccard",
    "op5_pii": "op5_pii",
    "op6_kneser_ney": "op6_kneser_ney",
    "op7_merkle": "op7_merkle",
    "op8_langid": "op8_langid",
    "op9_mixing": "op9_mixing",
    "op10_repair": "op10_repair",
    "op11_trie": "op11_trie",
    "op12_collisions": "op12_collisions",
    "op13_fim": "op13_fim",
}
ORACLE: dict[str, str] = {}


def queries() -> dict:
    out = {}
    for name, module in NAMES.items():
        m = importlib.import_module(f".{module}", __package__)
        out[name] = getattr(m, name)
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(ORACLE)
    for name, module in NAMES.items():
        m = importlib.import_module(f".{module}", __package__)
        if getattr(m, "ORACLE_SQL", None):
            out[name] = m.ORACLE_SQL
    return out
