"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

import functools
from pathlib import Path

from webquarry.llm import alignment, bpe, convtrie, langid, lattice, licenses, mixture, quality, simhash, substring, tokenfile, topk, triebpe

ROOT = str(Path(__file__).resolve().parents[2])


def importable(query):
    """Lets the Python workers of a session import this package from where the driver did; on a cluster it is installed or sent along."""

    @functools.wraps(query)
    def run(spark, *args):
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
        if ROOT not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
        return query(spark, *args)

    return run


QUERIES = {f.__name__: importable(f) for f in (
    topk.op1_topk,
    mixture.op2_mixture,
    langid.op3_langid,
    lattice.op4_lattice,
    licenses.op5_licenses,
    bpe.op6_byte_bpe,
    simhash.op7_simhash,
    tokenfile.op8_tokenfile,
    quality.op9_quality,
    substring.op10_substring,
    alignment.op11_alignment,
    convtrie.op12_conversation_trie,
    triebpe.op13_trie_bpe,
)}

ORACLES = {
    "op1_topk": topk.OP1_SQL,
    "op2_mixture": mixture.OP2_SQL,
}
