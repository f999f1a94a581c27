import random

import sentencepiece as lib
from pyspark.sql import Row

from noveltide.llm import sentencepiece as S

MODEL = S.Model()
SPEC = S.spec_of(MODEL)
LIB = lib.SentencePieceProcessor(model_file=S.MODEL)
TABLE = S.decode_table(MODEL)


def index():
    return S.Index(SPEC[1], *SPEC[2:])


EDGE = ["", " ", "  ", "a", " a", "a ", "hello world", "  two  spaces \n\tx ", "ﬁ é 漢字 🎉 ① ½", "aaa aaaa aaaaa", "▁x ▁▁y", "x" * 500, " " * 37 + "z", "a" + " " * 40, "\n\n\n", "the the The THE", "A B", "ø" * 20]


def test_matches_library_on_edges():
    got = index().encode(EDGE)
    for t, g in zip(EDGE, got):
        assert g.tolist() == LIB.encode(t), t
        assert S.decode_ids(g, TABLE) == LIB.decode(g), t


def test_matches_library_on_random_text():
    rnd = random.Random(1)
    letters = "abcdeinorst  éß漢🎉.,!1029ABC\n"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    words = "tion ing the Einheit pression über queue international antidisestablishment 12345 foo_bar() {} == return".split()
    texts += [" ".join(rnd.choice(words) + rnd.choice(["", "s", "ly", ".", ","]) for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    for t, g in zip(texts, index().encode(texts)):
        assert g.tolist() == LIB.encode(t), t


def test_long_unbroken_text():
    rnd = random.Random(4)
    run = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(200_000))
    texts = [run, "漢字日本語" * 40_000, "some words " + run[:65_600] + " and more", "x" * 65_534, "y" * 65_535, "z" * 65_536]
    for t, g in zip(texts, index().encode(texts)):
        assert g.tolist() == LIB.encode(t)


def test_null_text_and_nul_character():
    got = index().encode([None, "a\0b"])
    assert got[0] is None
    assert S.decode_ids(got[1], TABLE) == "a\0b"


def test_columns_pass_and_round_trip(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="ein Haus", token_idsx=3), Row(doc_id=1, text="ein Haus", token_idsx=3), Row(doc_id=2, text=None, token_idsx=None), Row(doc_id=3, text="", token_idsx=1)])
    enc = S.decode(S.encode(docs)).orderBy("doc_id").collect()
    assert [r.decoded for r in enc] == ["ein Haus", "ein Haus", None, ""]
    assert list(enc[0].token_ids) == LIB.encode("ein Haus")
    rt = S.round_trip(docs).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rt] == [len(LIB.encode("ein Haus"))] * 2 + [None, 0]
    assert [r.round_trip for r in rt] == [True, True, None, True]
    assert S.round_trip(docs.limit(0)).count() == 0
