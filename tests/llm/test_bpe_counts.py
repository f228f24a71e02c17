import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetwatch.llm import bpe_counts

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(docs, small, library):
    texts = ODD + [r.text for r in small.select("text").collect()]
    got = {r.doc_id: r for r in bpe_counts.count_tokens(docs(list(enumerate(texts))), PATH).collect()}
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 512), t


def test_overlapping_pairs_merge_from_the_left(library):
    merges = bpe_counts.ByteMerges(PATH)
    words = ["a" * n for n in range(1, 40)] + ["ab" * 9, "aab" * 7, "  ", "....", "=" * 33]
    assert merges.merge([w.encode() for w in words]).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_empty_table_clashing_columns_and_repeated_rows(docs):
    assert bpe_counts.count_tokens(docs([]), PATH).count() == 0
    rows = docs([(None, "one two", 5), (1, "one two", 6), (1, "one two", 6)], "doc_id long, text string, n_tokens int")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in bpe_counts.count_tokens(rows, PATH).collect()) == [(0, 2), (1, 2), (1, 2)]
