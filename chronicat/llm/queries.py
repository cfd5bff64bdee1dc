"""The registered queries of this subpackage and their SQL."""

from . import decontamination, exact_dedup, language_id, line_dedup, packing, pii, quality, simhash, substring_dedup, toxicity

MODULES = (toxicity, exact_dedup, quality, simhash, line_dedup, substring_dedup, pii, language_id, packing, decontamination)
QUERIES = {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
