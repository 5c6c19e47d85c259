import random

import public_tokenizers

from tracelode.llm.quality import quality_rules


def test_texts_broken_by_separators_are_rejected(spark):
    """The same words with and without a separator between each few of them."""
    rng = random.Random(4)
    words = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.choice('dnrst')}" for _ in range(120)]
    broken = " ".join(f"{w} |" for w in words)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, broken)], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got == {1: (False, True), 2: (False, False)}
