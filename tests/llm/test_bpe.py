import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import bpe
from loomline.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["", " ", "  \n", "a\n\nb", "foo  bar\t\tbaz ", "a\t  b", "!'ll a''ll don't", "x\x1cy \x1c z", "a\xa0 b　 c", "é́ ñ 中文字 🙂🙂", "<|endoftext|>", "hi <|endoftext|>  there<|endoftext|>\n", "a" * 5000, "ab 12345 " * 300, "'s 's' x's\r\n\r\n y", "\n \n  x", "end   "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_like_the_library(library, text):
    e = bpe.encoder(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(e.encode(text)) == want
    assert e.decode(e.encode(text)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r'!.,ablstre0129é\xa0\x1c <|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = library
    assert ids(bpe.encoder(PATH).encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_fragments_join_to_the_piece():
    e = bpe.encoder(PATH)
    for piece in ("Ġthequickxqzj", "ÃĥÂ©", "a"):
        assert "".join(e.fragments_of(piece)) == piece
    assert len(e.fragments_of("Ġzzxqj")) > 1


def test_query(spark, sf_dir, library):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "the cat", "x"), (3, "the cat", "x"), (4, "word " * 50000, "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs).collect())
    want = sorted((d or 0, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in docs.collect() for i in [library.encode(t or "", add_special_tokens=False).ids])
    assert got == want
    assert bpe.encode_digests(docs.limit(0)).count() == 0
    row = bpe.encode_texts(docs.filter("doc_id = 3")).first()
    assert row.decoded == "the cat" and row.ids == library.encode("the cat").ids


def test_whole_table(spark, sf_dir, library):
    from loomline.llm import catalog

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.QUERIES["op7_forced_boundary_bpe"](spark, sf_dir).collect()}
    for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        want = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert got[d] == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
