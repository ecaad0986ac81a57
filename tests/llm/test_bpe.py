import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from idlattice.llm import bpe

from ..conftest import SMALL

PATH = bpe.vocabulary()
LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = set()
    for r, ids in zip(docs, library([r.text or "" for r in docs]), strict=True):
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        expected.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert {tuple(r) for r in bpe.op2_bpe(spark, SMALL).collect()} == expected


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert bpe.bpe(PATH).encode_batch([text])[0].tolist() == library([text])[0]


def test_every_code_point():
    points = bpe.all_points()
    texts = [" ".join(f"a{c}b" for c in map(chr, points[k : k + 500])) for k in range(0, len(points), 500)]
    for k in range(0, len(texts), 100):
        assert [x.tolist() for x in bpe.bpe(PATH).encode_batch(texts[k : k + 100])] == library(texts[k : k + 100])


def test_marks_in_any_order():
    marks = [c for c in map(chr, bpe.all_points()) if bpe.unicodedata.combining(c)]
    texts = [f"q{c}{m} Q{m}{c}É" for c in marks for m in "\u0323\u0301\u0334"] + ["\U00011935\U00011930 é", "e\u0301\u0323x"]
    assert [x.tolist() for x in bpe.bpe(PATH).encode_batch(texts)] == library(texts)


def test_words_built_from_tokens():
    rng = random.Random(3)
    names = [t.removesuffix("</w>") for t in bpe.bpe(PATH).ids if t.isascii()]
    texts = ["".join(rng.choice(names) for _ in range(4)) for _ in range(3000)]
    assert [x.tolist() for x in bpe.bpe(PATH).encode_batch(texts)] == library(texts)


@pytest.mark.parametrize("text", ["", " \n\t", "<|startoftext|>Hi<|endoftext|>", "<|STARTOFTEXT|>", "ΑΣ Σ", "a\x1cb\x85c", "é İ ½²Ⅷ", "ab" * 4000, "don't I'LL 'S"])
def test_odd_texts(text):
    coder = bpe.bpe(PATH)
    ids = coder.encode_batch([text])[0].tolist()
    assert ids == library([text])[0]
    assert coder.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([("x", None, 1), ("y", "The cat", None), ("y", "The cat", None), ("z", "", 2)], "ids string, text string, doc_id long")
    rows = bpe.encode(docs, PATH).collect()
    assert sorted((len(r.ids), r.decoded) for r in rows) == [(0, ""), (0, ""), (2, "the</w> cat</w>"), (2, "the</w> cat</w>")]
    assert bpe.decode(bpe.encode(docs, PATH, decoded=None), PATH).where("doc_id is null").first().decoded == "the</w> cat</w>"
    assert bpe.encode(docs.limit(0), PATH).count() == 0
