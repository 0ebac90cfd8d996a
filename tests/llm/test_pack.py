"""What the packing's encoder keeps."""

from recordloom.llm.pack import Encoder, tokenizer_path


def test_words_that_return_are_kept(monkeypatch):
    """Many words that are met once don't drive out those that are met again and again; the ids are those of whole texts either way."""
    enc = Encoder(tokenizer_path(), keep=200)
    common = [f"common{chr(97 + i)}" for i in range(20)]
    asked = []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (asked.extend(words), learn(words))[1])
    for i in range(40):
        # common words stand in every second slice, between slices of others only
        texts = ["x " + " ".join(common)] if i % 2 == 0 else ["x " + " ".join(f"rare{i}n{k}" for k in range(45))]
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode(texts)] == want
        assert len(enc.known) <= 200 and len(enc.again) == len(enc.known) == len(enc.end) - 1
    assert max(asked.count(f" {w}") for w in common) <= 2


def test_what_leaves_no_room_is_forgotten():
    enc = Encoder(tokenizer_path(), keep=60)
    for i in range(6):
        for _ in range(2):  # everything is met again
            texts = ["x " + " ".join(f"w{i}n{k}" for k in range(40))]
            assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(enc.known) <= 60
