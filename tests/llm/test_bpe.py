import hashlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusql.llm.bpe import Encoder, decoded, default_vocabulary, encoded, token_digests

TEXTS = [
    "", " ", "  a", "a  b\n\n c", "it's  '  's \t x y", "<|endoftext|>hi <|endoftext|>",
    "日本語 тест 123 ½ ² x_y ​​", "a" * 300, "\r\n x \r\n", "é́ 🎉👩‍👩",
    " \n a", "!!!!!!???", "<|endoftext|>", "a<|endoftext|> <|endoftext|>\n", "x\x1c\x1cy \x1f z\x85q",
    "The the the the 　x\n", "word " * 5000,
]


def test_same_ids_as_the_library(spark, documents):
    library = Tokenizer.from_file(default_vocabulary())
    df = documents(TEXTS + [None, TEXTS[3]]).withColumn("token_ids", F.lit("clash"))
    rows = decoded(encoded(df)).collect()
    assert len(rows) == len(TEXTS) + 2
    for row in rows:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert list(row.token_ids) == want
        assert row.decoded == library.decode(want, skip_special_tokens=False)


def test_digests(spark, documents):
    library = Tokenizer.from_file(default_vocabulary())
    for row in token_digests(documents(TEXTS + [None])).collect():
        text = "" if row.doc_id == len(TEXTS) else TEXTS[row.doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        shown = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert token_digests(documents([]).limit(0)).count() == 0


def test_trie_walk_equals_plain_merging():
    encoder = Encoder(default_vocabulary())
    words = sorted({t.encode() for t in TEXTS for t in encoder.pattern.findall(t)})
    for word, ids in zip(words, encoder.walk(words)):
        assert ids == encoder.vocabulary.merged(word)


def test_pieces_carry_the_bytes_of_their_ids():
    encoder = Encoder(default_vocabulary())
    for text, pieces in zip(TEXTS, encoder.encode(TEXTS)):
        ids = [int(i) for _, shown, _ in pieces for i in shown.split(",")]
        assert b"".join(raw for _, _, raw in pieces).decode("utf-8", "replace") == encoder.decode(ids) == text


def test_only_tokens_a_text_ends_in_are_asked_for():
    """A state knows the tokens a text ends in, all of them, so no other bytes are looked up."""
    encoder = Encoder(default_vocabulary())
    vocabulary = encoder.vocabulary
    words = sorted({t.encode() for t in TEXTS for t in encoder.pattern.findall(t)})
    assert all(ids == vocabulary.merged(word) for word, ids in zip(words, encoder.walk(words)))
    assert len(vocabulary.state_bytes) > 50
    for word in words:
        state = 0
        for size in range(1, min(len(word), 300) + 1):
            state = vocabulary.step(state, word[size - 1])
            tails = (word[at:size] for at in range(size))
            assert vocabulary.ends[state] == [(len(t), vocabulary.ids[t]) for t in tails if t in vocabulary.ids]
