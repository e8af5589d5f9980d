"""The size of benchmark blocks does not change what decontaminate cuts."""

import pytest
from tessera.llm import decontaminate as D


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_overlapping_windows_of_items_in_different_blocks(spark):
    words = [f"w{i}" for i in range(1, 21)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[4:]))], "doc_id long, text string")
    cuts = set()
    for ids in range(8):                                                # several ids, so that some pairs fall in different blocks
        bench = spark.createDataFrame([(ids, " ".join(words[:15])), (ids + 100, " ".join(words[7:18]))], "item_id long, text string")
        cuts.add(str(rows(D.decontaminate(docs, bench, block_bytes=50))))
    assert cuts == {str([(1, " w19 w20"), (2, "x  w19 w20")])}


@pytest.mark.parametrize("block_bytes", [1500])
def test_blocks_and_one_block(documents, benchmark, odd, block_bytes):
    for docs in (documents, odd):
        assert rows(D.decontaminate(docs, benchmark, block_bytes=block_bytes)) == rows(D.decontaminate(docs, benchmark))
