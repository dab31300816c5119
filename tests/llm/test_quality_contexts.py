"""Word vectors of the quality classifier cover documents without labels too."""

import numpy as np

from patternweave.llm import quality


def test_vectors_come_from_all_documents(spark):
    texts = {1: "good words stand here", 2: "bad BAD words 77 !!", 3: "others never labelled 12 stand by", 4: None}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    index, into = quality.index_vectors(), np.zeros((quality.ENTRIES, quality.DIMENSIONS))
    quality.contexts([t and t.encode() for t in texts.values()], index, into)
    vectors, _ = quality.fit(docs, labels)
    assert np.array_equal(vectors, quality.word_vectors(index, into.astype(np.float32)).astype(np.float32))
