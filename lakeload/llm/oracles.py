"""DuckDB SQL of the queries that SQL can express.

The others learn a model, hash, align, decode or write files. Their tests compare
them with brute force, exact round trips or held-out rows.
"""

from lakeload.llm import divergence, licenses, variants

ORACLES: dict[str, str] = {
    "op7_license_scan": licenses.oracle_sql(),
    "op11_source_divergence": divergence.oracle_sql(),
    "op12_spelling_variants": variants.oracle_sql(),
}
