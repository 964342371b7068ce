import random

import pytest

from passagemill.llm.encode import encode_corpus, reencode_edits
from passagemill.llm.prefix_bpe import prefix_encoder
from passagemill.llm.vocab import batch_encoder, tokenizer_hash

TEXTS = ["", " ", "Hello  world\n\n it's 3.14", "字符串和漢字テスト", "a" * 3000, "<|endoftext|> is ordinary", "é́ ñ 🙂🙂", "\t\r\n x", "ابجد هوز"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_same_ids_as_the_public_encoder(name):
    own, public = prefix_encoder(name), batch_encoder(name)
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab 12'\n的é🙂.,") for _ in range(rng.randrange(80))) for _ in range(200)]
    for text in TEXTS + mixed:
        assert own.encode(text) == public([text])[0]


def test_appending_bytes_gives_the_encoding_of_every_prefix():
    own = prefix_encoder("byte_bpe_50k")
    data = "unbelievable的thinking".encode()
    whole = own.extend([], data)
    grown = own.extend(own.extend([], data[:7]), data, 7)
    assert grown == whole
    for n in range(1, len(data) + 1):
        assert own.walk_back(whole, n) == own._merge(data[:n])


def test_edits_reuse_what_lies_outside_them():
    own = prefix_encoder("byte_bpe_50k")
    rng = random.Random(2)
    text = "The river guild  kept three mills,\n\n and it's 12 o'clock   now. " * 3
    for _ in range(300):
        i = rng.randrange(len(text) + 1)
        j = min(len(text), i + rng.randrange(5))
        new = text[:i] + rng.choice(["", "x", "  ", " 7", "\n", "字"]) + text[j:]
        found = own.encode_edited(own.encode_with_places(text), new)
        fresh = own.encode_with_places(new)
        assert found.ids == own.encode(new) and (found.ids, found.starts, found.places) == (fresh.ids, fresh.starts, fresh.places)


def test_edits_of_long_texts_encode_only_what_is_near():
    own = prefix_encoder("byte_bpe_50k")
    known = own.encode_with_places("The river guild kept three mills, and it's 12 o'clock now. " * 2000)
    rng = random.Random(5)
    for _ in range(40):
        i = rng.randrange(len(known.text))
        known = own.encode_edited(known, known.text[:i] + rng.choice(["word ", "", "7", " 字"]) + known.text[i + rng.randrange(3) :])
        assert known.encoded_bytes < 80
    appended = own.encode_edited(known, known.text + " The end.")
    assert appended.encoded_bytes < 40
    assert appended.ids == own.encode(appended.text)
    assert own.encode_edited(own.encode_with_places(""), "a b").ids == own.encode("a b") and own.encode_edited(known, "").ids == []


def test_edited_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "Hi there, all of you. " * 200, "The new title"), (3, "Hi", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, title string").selectExpr("*", "1 as same")
    got = reencode_edits(docs).collect()
    assert len(got) == 4 and all(r.same for r in got)
    long = next(r for r in got if r.n_bytes > 1000)
    assert long.encoded_bytes < 100
    assert reencode_edits(docs.filter("false")).count() == 0


def test_every_row_has_ids(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hi there", None), (3, "Hi there", "y"), (None, "Hi", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = sorted(((r.doc_id or 0, list(r.ids)) for r in encode_corpus(docs).collect()))
    ids = batch_encoder("byte_bpe_50k")(["Hi there", "Hi"])
    assert found == [(0, ids[1]), (1, []), (2, []), (3, ids[0]), (3, ids[0])]
    assert encode_corpus(docs.filter("false")).count() == 0


def test_tokenizer_hash_names_the_content():
    assert tokenizer_hash("byte_bpe_50k") != tokenizer_hash("byte_bpe_multi_50k")
