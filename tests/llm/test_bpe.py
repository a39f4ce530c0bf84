"""The encoder against the tokenizers library."""

import random

import numpy as np
import pytest

from siftwell.llm import bpe

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def built():
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path(NAME))
    theirs.no_truncation()
    theirs.no_padding()
    v = bpe.Vocabulary(bpe.vocabulary(NAME))
    return bpe.Encoder(v, bpe.BpeParams(most_pieces=500, most_pairs=500)), bpe.Decoder(v), theirs


def ids_of(encoder, text):
    return np.frombuffer(encoder.of(text), "<u4").tolist()


def test_random_texts(built):
    encoder, decoder, theirs = built
    r = random.Random(5)
    parts = ["a", "b", "t", "h", "e", " ", "  ", "\n", "'s", "'", "1", "é", "中", "😀", "<|endoftext|>", "<|endof", "ing", "!!", "\t", " ", "\x1c", "\x85", "​", "İ", "ation", "0123", "the"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids_of(encoder, text) == want, text
        assert decoder.of(encoder.of(text)) == theirs.decode(want, skip_special_tokens=False) == text


def test_every_code_point_is_cut_alike(built):
    encoder, _, theirs = built
    for c in [*range(0x3100), *range(0xD7B0, 0xD800), *range(0xE000, 0x10000, 7), *range(0x10000, 0x32000, 11)]:
        text = f"a{chr(c)} {chr(c)}1 {chr(c) * 2}\n"
        assert ids_of(encoder, text) == theirs.encode(text, add_special_tokens=False).ids, hex(c)


def test_any_ids_decode_alike(built):
    _, decoder, theirs = built
    r = random.Random(7)
    for _ in range(2000):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 8))]
        assert decoder.of(np.array(ids, "<u4").tobytes()) == theirs.decode(ids, skip_special_tokens=False)


def test_long_pieces_take_one_pass(built):
    encoder, _, theirs = built
    for text in ("ab" * 20_000, "a" * 30_000, "=" * 9_999, " " * 5_000):
        assert ids_of(encoder, text) == theirs.encode(text, add_special_tokens=False).ids


def test_compatible_pairs_are_what_the_library_leaves(built):
    """Two tokens are compatible exactly if the library encodes their bytes as these two."""
    encoder, _, theirs = built
    r = random.Random(11)
    model = theirs.model
    letters = [t for t in encoder.v.reachable if all(97 <= b <= 122 for b in encoder.v.bytes_of[t])]
    for _ in range(3000):
        a, b = r.choice(letters), r.choice(letters)
        plain = (encoder.v.bytes_of[a] + encoder.v.bytes_of[b]).decode()
        assert encoder.compatible(a, b) == ([t.id for t in model.tokenize(plain)] == [a, b])


def test_vocabularies_that_are_not_plain_are_refused():
    import json

    spec = json.loads(bpe.vocabulary(NAME))
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "Lowercase"}}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(spec | change).encode())
    spec["model"]["merges"] = [*spec["model"]["merges"], spec["model"]["merges"][0]]
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(spec).encode())


def test_rows(spark, built):
    """Nulls, empty texts, repeated rows and ids, another order of columns, long texts, an empty table."""
    import hashlib

    _, _, theirs = built
    rows = [(None, "the cat"), (1, None), (1, ""), (2, "le chat\n"), (2, "le chat\n"), (3, "word " * 50_000), (4, "x<|endoftext|>y")]
    docs = spark.createDataFrame([("no", t, i) for i, t in rows], "ids string, text string, doc_id long")
    got = sorted(map(tuple, bpe.digest(bpe.decoded(bpe.encoded(docs))).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digest(bpe.decoded(bpe.encoded(docs.limit(0)))).count() == 0


def test_query_on_whole_documents(spark, built):
    import hashlib

    import __spark_entry__ as entry

    _, _, theirs = built
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in entry.queries()["op13_prefix_bpe"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids, r = theirs.encode(d.text or "", add_special_tokens=False).ids, got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
