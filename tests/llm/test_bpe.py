import hashlib
import json
import random

import pyarrow as pa
import pytest

from rankweave.llm import bpe
from rankweave.llm.queries import vocabulary_path
from tests.llm.conftest import ODD

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = vocabulary_path()
    return bpe.load(path), tokenizers.Tokenizer.from_file(path)


def samples():
    rng = random.Random(8)
    parts = ["a", "b", " ", "  ", "the", "ing", "é", "ß", "日本", "\n", "\t", "'s", "'ll", "1", "23", "!!!", "<|endoftext|>", "\U0001f600", "́", "_", "²", "\x1c", "　", "\x00"]
    return [x or "" for x in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)]


def test_same_ids_and_text_as_the_library(both):
    ours, theirs = both
    for text in samples():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, repr(text)
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("window", [12, 17, 50])
def test_windows_change_nothing(both, window):
    ours, theirs = both
    for text in samples()[::3]:
        ids = [int(i) for batch in ours.batches(text, window) for s, _ in batch for i in s.split(",")]
        assert ids == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("unit", ["日本語の文章は空白なしで続く", "THE QUICK BROWN FOX ", "ABC", "!?", "  ", "12", "a\u0301"])
def test_long_texts_without_lower_case_words_stay_in_pieces(both, unit):
    """No piece is longer than a window, and the ids are the library's."""
    ours, theirs = both
    text = "x" + unit * (300_000 // len(unit)) + "end"
    held = list(ours.batches(text, 20_000))
    assert max(sum(len(raw) for _, raw in batch) for batch in held) <= 130_000
    assert [int(i) for batch in held for s, _ in batch for i in s.split(",")] == theirs.encode(text, add_special_tokens=False).ids


def test_other_kinds_of_files_are_refused():
    with open(vocabulary_path()) as f:
        spec = json.load(f)
    bpe.check_settings(spec)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", None), ("model", spec["model"] | {"byte_fallback": True})):
        with pytest.raises(ValueError):
            bpe.check_settings(spec | {key: value})
    with pytest.raises(ValueError):
        bpe.check_settings(spec | {"added_tokens": [{"id": 0, "content": "x", "lstrip": True}]})


def test_decoding_any_ids(both):
    ours, theirs = both
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_streaming_emits_early_and_keeps_a_window(both):
    ours, theirs = both
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij") for _ in range(6000))
    fed = 0

    def chunks():
        nonlocal fed
        for k in range(0, len(text), 7):
            fed += 7
            yield text[k : k + 7].encode()

    out, late = [], 0
    for token in ours.stream(chunks()):
        out.append(token)
        late = max(late, min(fed, len(text)) - len(ours.decode(out)))
    assert out == theirs.encode(text, add_special_tokens=False).ids
    assert late <= 5 * ours.lookahead + 7


def test_bytes_split_anywhere():
    raw = "aé日\U0001f600".encode() + b"\xf0\x9f\xc3\xe2\x82A\xed\xa0\x80\xff"
    for step in (1, 2, 3):
        machine = bpe.Utf8()
        assert "".join(machine.feed(raw[k : k + step]) for k in range(0, len(raw), step)) + machine.end() == raw.decode("utf-8", "replace")


def test_column(both, make):
    ours, theirs = both
    long_text = "some words here. " * 40000
    texts = [*ODD, long_text]
    out = bpe.encode_columns(make(texts), vocabulary_path(), with_ids=True).orderBy("doc_id").collect()
    for text, r in zip(texts, out, strict=True):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_columns(make([]), vocabulary_path()).isEmpty()


def test_copies_next_to_each_other_are_encoded_once(both, make, monkeypatch):
    """Also across batches; equal texts with others between them and null texts keep their rows."""
    _, theirs = both
    texts = ["a b c", "a b c", "a b c", "é d", "a b c", None, "", None, "x y", "x y"]
    calls, digest = [], bpe._digest
    monkeypatch.setattr(bpe, "_digest", lambda b, text, *a: calls.append(text) or digest(b, text, *a))
    docs = make(texts)
    monkeypatch.setattr(bpe, "HELD", 7)  # so a batch is handed on in several
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = bpe.encode_columns(docs, vocabulary_path(), with_ids=True)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [*range(a, b)], "text": pa.array(texts[a:b], pa.string())}) for a, b in ((0, 2), (2, 9), (9, 10))]
    out = list(run(iter(batches)))
    rows = [r for batch in out for r in batch.to_pylist()]
    assert len(out) > len(batches) and calls == ["a b c", "é d", "a b c", "", "x y"]
    assert [r["doc_id"] for r in rows] == [*range(len(texts))]
    for text, r in zip(texts, rows, strict=True):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_states_given_up_change_nothing(both, monkeypatch):
    """However few steps between states are kept, and in the middle of a pre-token."""
    _, theirs = both
    monkeypatch.setattr(bpe.Bpe, "STEPS", 20)
    ours = bpe.Bpe(vocabulary_path())
    for text in [*samples()[::2], "abcdefghij" * 300 + "日本語" * 200]:
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids, repr(text)
        assert ours._steps <= 21
