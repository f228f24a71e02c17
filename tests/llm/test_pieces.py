import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from fleetwatch.llm import pieces

from .conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")
MORE = [" a  b   c    ", "      z", "x" * 600, "<s> </s> <unk> <0x41>", "aaaaaaaaaaaaa " + "a" * 60, "İstanbul ΣΑΣ ʼn ﬁ", " ", "  "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library_and_come_back(docs, small, library):
    texts = ODD + MORE + [r.text for r in small.select("text").collect()]
    df = pieces.encode(docs(list(enumerate(texts))), PATH)
    got = {r.doc_id: r for r in df.collect()}
    for k, t in enumerate(texts):
        want = library.encode(t or "")
        assert got[k].ids == want and got[k].n_pieces == len(want), t
        assert got[k].round_trip == (library.decode(want) == (t or "")), t
    back = pieces.decode(df.select("ids").coalesce(1), PATH).collect()
    assert sorted(r.text for r in back) == sorted(library.decode(r.ids) for r in got.values())


def test_borders_of_pieces(library):
    table = pieces.Pieces(PATH)
    import numpy as np
    rng = np.random.default_rng(1)
    plain = [i for i in table.ids_of.tolist() if not library.id_to_piece(i).startswith(pieces.BLANK)]
    a, b = rng.choice(plain, 3000), rng.choice(plain, 3000)
    words = [library.id_to_piece(int(x)) + library.id_to_piece(int(y)) for x, y in zip(a, b, strict=True)]
    ids, length = table.encode_words(words)
    got = np.split(ids, np.cumsum(length)[:-1])
    assert [g.tolist() for g in got] == [library.encode(w) for w in words]


def test_empty_table_and_clashing_columns(docs):
    assert pieces.encode(docs([]), PATH).count() == 0
    rows = docs([(None, "one", 1), (2, None, 2), (2, None, 2)], "doc_id long, text string, ids int")
    assert sorted(r.n_pieces for r in pieces.encode(rows, PATH).collect())[:2] == [0, 0]


@pytest.mark.parametrize("limit", [1, 4, 50])
def test_ids_do_not_depend_on_the_cache_limit(library, monkeypatch, limit):
    monkeypatch.setattr(pieces.Pieces, "LIMIT", limit)
    table = pieces.Pieces(PATH)
    many = " ".join(f"word{k}  x{k}" for k in range(60))
    for texts in ([many, "a  b   c"], ["plain text"], MORE, [many], ["one   two", " "]):
        ids, edges = table.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [library.encode(t) for t in texts]
        assert len(table.at) <= max(limit, 200)
