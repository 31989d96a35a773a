"""Queries of the text operators for ``__spark_entry__``, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .fingerprints import op8_fingerprints
from .language_model import op10_language_model
from .licenses import OP5_SQL, op5_licenses
from .lines import OP4_SQL, op4_lines
from .near_duplicates import op3_near_duplicates
from .packing import op6_packing
from .periodic_runs import op12_periodic_runs
from .pii import op2_pii
from .repeats import op7_repeats
from .toxicity import op9_toxicity
from .warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_lines": op4_lines,
    "op5_licenses": op5_licenses,
    "op6_packing": op6_packing,
    "op7_repeats": op7_repeats,
    "op8_fingerprints": op8_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op10_language_model": op10_language_model,
    "op11_warc": op11_warc,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {"op4_lines": OP4_SQL, "op5_licenses": OP5_SQL, "op11_warc": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
