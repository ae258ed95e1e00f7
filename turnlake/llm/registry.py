"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from . import bpe, decontam, langid, lm, quality_classifier, quality_rules, secrets, sharding, simhash, spelling, substrings, url_filters, whitening

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_substrings": substrings.op2_substrings,
    "op3_sharding": sharding.op3_sharding,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontam": decontam.op5_decontam,
    "op6_secrets": secrets.op6_secrets,
    "op7_lm": lm.op7_lm,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_whitening": whitening.op11_whitening,
    "op12_url_filters": url_filters.op12_url_filters,
    "op13_spelling": spelling.op13_spelling,
}
SQL = {"op6_secrets": secrets.OP6_SQL, "op5_decontam": decontam.OP5_SQL, "op2_substrings": substrings.OP2_SQL, "op3_sharding": sharding.OP3_SQL, "op9_quality_rules": quality_rules.OP9_SQL, "op12_url_filters": url_filters.OP12_SQL, "op13_spelling": spelling.OP13_SQL}
