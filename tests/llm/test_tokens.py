import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from geneloom.llm import packing, queries, records, tokens

ODD = ["", " ", "a", "a\x0bb\x0cc", "don't  we'll\t\n x", "É È é ́x", "a b c\u0085d\x1ce", "<|endoftext|> x", "😀 naïve ß İ ΑΣ ΑΣ.", "x" * 5000, None]


def direct(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_encoder_equals_whole_text_encoding(texts):
    sample = ODD + [t for _, t in texts[:60]]
    ids, bounds = tokens.encoder(tokens.default_tokenizer()).encode(pa.array(sample, pa.string()))
    for text, a, b in zip(sample, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == direct(text), text


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_CHUNKS", 1)
    coder = tokens.Encoder(tokens.default_tokenizer())
    for text in ("one two three", "two four", "", "one"):
        ids, bounds = coder.encode(pa.array([text]))
        assert ids.tolist() == direct(text) and bounds.tolist() == [0, len(ids)]


def test_words_before_marks_are_encoded_once():
    coder, asked = tokens.Encoder(tokens.default_tokenizer()), []

    class Spy:
        def encode_batch(self, groups, **options):
            asked.extend(x for g in groups for x in g)
            return plain.encode_batch(groups, **options)

    plain, coder.tokenizer = coder.tokenizer, Spy()
    for text in ("alpha beta \u00e9l\u00e9ment", "alpha, beta. alpha... Beta!? \u00c9l\u00e9ment, gamma,"):
        ids, bounds = coder.encode(pa.array([text]))
        assert ids.tolist() == direct(text) and bounds.tolist() == [0, len(ids)]
    assert not any(x in asked for x in ("alpha,", "beta.", "alpha...", "gamma,")) and asked.count("alpha") == asked.count("beta") == asked.count("gamma") == 1


def test_marks_behind_all_sorts_of_chunks():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_tokenizer())
    rng = random.Random(11)
    signs = ["a", "b", "S", "t", "re", "\u00e9", "\u00c9", "\u00df", "\u0130", "\u0149", "\u0301", "\u0338", "\u2014", "1", "'", "'s", "_", "-", ",", ".", "<", ">", "<|endoftext|>", "|>", "\u03a3", "\U0001f600", " ", "\n"]
    parts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for at in range(0, len(parts), 100):  # of their own: an added token changes how a batch is read
        ids, bounds = tokens.encoder(tokens.default_tokenizer()).encode(pa.array(parts[at:at + 100]))
        for text, a, b in zip(parts[at:], bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == [*whole.encode(text, add_special_tokens=False).ids, tokens.END_ID], text


def test_bounded_batches_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 9, 30, 1, 1)] + [None]})
    parts = list(tokens.bounded(iter([batch]), "text", 10))
    assert [r["text"] for p in parts for r in p.to_pylist()] == batch.column("text").to_pylist()
    assert max(sum(len(t or "") for t in p.column("text").to_pylist()) for p in parts if p.num_rows > 1) <= 10


def test_checksum_of_known_value():
    assert [hex(x) for x in records.crc32c([b"123456789", b"\0" * 32, b"\xff" * 32])] == ["0xe3069283", "0x8a9136aa", "0x62a8ab43"]


def test_checksum_over_many_lanes():
    def plain(data):
        state = 0xFFFFFFFF
        for byte in data:
            state = int(records._BYTE[(state ^ byte) & 255]) ^ (state >> 8)
        return state ^ 0xFFFFFFFF

    rng = random.Random(1)
    payloads = [rng.randbytes(n) for n in (4, 5, 255, 256, 257, 1000, 40_000)]
    assert records.crc32c(payloads).tolist() == [plain(p) for p in payloads]


def test_records_refuse_damage():
    documents = [(None, np.array([2], np.uint32)), (7, np.array([1, 70_000], np.uint32)), (-3, np.zeros(0, np.uint32))]
    data, sizes = records.frame([records.pack_document(k, i) for k, i in documents])
    assert [(k, i.tolist()) for k, i in map(records.unpack_document, records.unframe(data))] == [(k, i.tolist()) for k, i in documents]
    assert len(data) == sizes.sum()
    for at in (3, 9, 15, len(data) - 1):
        with pytest.raises((ValueError, struct.error)):
            records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])
    with pytest.raises(ValueError):
        records.unframe(data[:-2])


def test_token_files_round_trip(spark, frame):
    rows = list(enumerate(ODD)) + [(3, "a"), (3, "b"), (None, "without id")]
    got = records.round_trip(spark, frame(rows)).collect()
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((k is None, k or 0, np.array(direct(t), "<u4").tobytes()) for k, t in rows)


def test_empty_tables(spark, frame):
    assert records.round_trip(spark, frame([])).count() == 0
    assert packing.pack_documents(frame([])).count() == 0


def test_query_of_token_files_equals_plain_encoding(spark, texts):
    got = {r.doc_id: r for r in queries.op8_token_records(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for k, text in sorted(texts):
        ids = direct(text)
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(texts)


def check_packing(got, rows, window=4096):
    ids = sorted((k is None, k or 0, crc(direct(t)), len(direct(t))) for k, t in rows)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    assert sum(r.length for r in got) == sum(x[3] for x in ids)
    return sum(r.length for r in got) / (window * len(by_seq))


def test_packing_of_a_table(spark, texts):
    got = queries.op2_packing(spark, "/root/testdata/sf0.001").collect()
    fill = check_packing(got, texts)
    assert fill > 0.97
    whole = {k: direct(t) for k, t in texts}
    for r in got:
        assert r.ids_crc32 == crc(whole[r.doc_id][r.start:r.start + r.length]) and r.doc_tokens == len(whole[r.doc_id])


def test_packing_of_odd_rows(spark, frame):
    rows = list(enumerate(ODD)) + [(3, "a"), (3, "a"), (None, "without id"), (99, "word " * 9000)]
    got = packing.pack_documents(frame(rows)).collect()
    check_packing(got, rows)
    assert sorted(r.start for r in got if r.doc_id == 99) == [0, 4096, 8192]


def test_packed_sequences_hold_the_ids(spark, frame):
    rows = [(k, "the text of number %d " % k * (k + 1)) for k in range(40)]
    packed = packing.sequences(frame(rows), window=64).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 256 for r in packed)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in packed])
    assert sorted(ids.tolist()) == sorted(x for _, t in rows for x in direct(t))


def test_best_fit_is_the_tightest():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 64, 3000)
    which, offset = packing.best_fit_decreasing(lengths, 64)
    room, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(room[k], k) for k in range(len(room)) if room[k] >= lengths[i]]
        if not fits:
            room.append(64)
            fits = [(64, len(room) - 1)]
        cap = min(fits)[0]
        assert 64 - offset[i] == cap and room[which[i]] == cap
        room[which[i]] -= lengths[i]
    assert len(room) == which.max() + 1


def test_encoder_of_odd_texts():
    """Letters that change with case or composition, separators of several kinds, more chunks than are encoded together."""
    coder = tokens.Encoder(tokens.default_tokenizer())
    odd = ["", " \n", "İ Á KKK İx", "DON'T stop Now", "A" * 5000, "\x1cA B\x85C", "É ẞ ΣΣ A\x0bB\x0cC\x00D", " ".join(f"W{i}x." for i in range(700))]
    for part in (odd, odd[::-1], [None], ["<|ENDOFTEXT|> a", "b<|EndOfText|>C"], ["<|endoftext|> A", "B<|endoftext|>c"]):
        ids, bounds = coder.encode(pa.array(part, pa.string()))
        for text, a, b in zip(part, bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]
