"""BPE by trie traversal against the tokenizers library: ids, decoded text and digests."""

import hashlib
import random

import public_tokenizers
import pytest

from parcelflow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_random_texts(library):
    own = bpe.Codec(open(PATH).read())
    alphabet = "abcdefghijklmnopqrstuvwxyz'.,!?-é ß漢́İΣς 　\x85\x1c0123456789<|>endoftextЖ\U0001f600"
    draw = random.Random(5)
    for turn in range(1500):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))
        if turn % 5 == 0:
            text += "<|endoftext|>" + text + "<|startoftext|><|endoftext|>"
        want = library.encode(text, add_special_tokens=False).ids
        (got,) = own.encode([text.encode()])
        assert got == want and own.decode(got) == library.decode(want, skip_special_tokens=False), text


@pytest.mark.parametrize("name", ["edge", "tiny"])
def test_documents(request, library, name):
    docs = request.getfixturevalue(name)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(bpe.encode_decode(docs, PATH)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_forgetting_changes_nothing(monkeypatch, tiny):
    texts = [r.text.encode() for r in tiny.limit(40).collect()]
    content = open(PATH).read()
    whole = bpe.Codec(content).encode(texts)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 100_000)
    monkeypatch.setattr(bpe, "PAIRS", 500)
    own = bpe.Codec(content)
    assert [own.encode([t])[0] for t in texts] == whole


def test_empty_table(nothing):
    assert bpe.encode_decode(nothing, PATH).count() == 0
