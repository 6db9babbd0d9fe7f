"""Prose passages of 50 words that two documents share have a common signature at the production levels.

Passages that only repeat a few words are runs of one symbol at a low level and may share none.
"""

from __future__ import annotations

import random

from inkwell.llm import fingerprint as P
from tests.llm.helpers import docs


def test_shared_passages_of_50_words_meet(spark) -> None:
    rng = random.Random(4)
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    texts = [t for t in texts if len(t) > 200]
    rows = []
    for k in range(300):
        while True:
            source, *around = rng.sample(texts, 5)
            at = rng.randrange(len(source) - 50)
            if len(set(source[at : at + 50])) > 5:
                break
        for j in (0, 2):
            before, after = (" ".join(t[: rng.randint(20, 150)]) for t in around[j : j + 2])
            rows.append((2 * k + j // 2, f"{before} {' '.join(source[at : at + 50])} {after}"))
    got = {r.doc_id: (set(r.signatures), set(r.fine_signatures)) for r in P.fingerprints(docs(spark, rows)).collect()}
    missed = [sum(not got[2 * k][i] & got[2 * k + 1][i] for k in range(300)) for i in (0, 1)]
    assert missed[0] > missed[1] == 0, missed
