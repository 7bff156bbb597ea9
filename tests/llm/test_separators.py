import numpy as np
import pytest
from llm.conftest import rows_of

from drayline.llm import separators as sp
from drayline.llm.base import write_file
from drayline.session import shared_dir


@pytest.mark.parametrize("block", [64, 4096, 4 << 20])
def test_counts(spark, odd_documents, block):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(sp.tokenizer_path(sp.FlatOptions()))
    tool.encode_special_tokens = True
    expected = [
        (r["doc_id"], len(tool.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in odd_documents.collect()
    ]
    found = sp.counted_documents(odd_documents, shared_dir(spark, "test-flat"), sp.FlatOptions(block_bytes=block))
    assert rows_of(found) == sorted(expected, key=str)


@pytest.mark.parametrize("block", [2, 4, 6, 1000])
def test_borders_are_stitched(spark, block):
    folder = shared_dir(spark, "test-flat")
    files = {"a": [9, 1, 2, 9, 9, 3, 3, 3, 3, 3, 9, 4], "b": [1, 1, 1, 1], "c": [9], "d": [5, 9]}
    for name, ids in files.items():
        write_file(folder, name, [np.array(ids, "<u2").tobytes()])
    found = sp.count_files(spark, folder, list(files), sp.FlatOptions(end_id=9, block_bytes=block))
    assert rows_of(found) == [
        ("a", 0, 0, 1, True), ("a", 1, 1, 3, True), ("a", 2, 4, 1, True), ("a", 3, 5, 6, True), ("a", 4, 11, 1, False),
        ("b", 0, 0, 4, False), ("c", 0, 0, 1, True), ("d", 0, 0, 2, True),
    ]


def test_empty_table(spark, no_documents):
    assert sp.counted_documents(no_documents, shared_dir(spark, "test-flat")).collect() == []
