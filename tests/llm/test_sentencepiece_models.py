"""Small models with every kind of piece, against the sentencepiece library, on random texts that hold the pieces' own strings."""

import random
import struct

import pytest

from cairnfold.llm import sentencepiece_codec as codec

KINDS = {"normal": 1, "unknown": 2, "control": 3, "user": 4, "unused": 5, "byte": 6}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def model(pieces, algorithm, byte_fallback=True, prefix=True, extra=False):
    """The bytes of a model file."""
    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([24, KINDS[k]])) for p, s, k in pieces)
    trainer = bytes([24, algorithm]) + varint(35 << 3) + bytes([byte_fallback]) + varint(4 << 3) + varint(len(pieces))
    normaliser = field(1, b"identity") + bytes([24, prefix, 32, extra, 40, 1])
    return out + field(2, trainer) + field(3, normaliser)


HEAD = [("<unk>", 0, "unknown"), ("<s>", 0, "control"), ("</s>", 0, "control")]
BYTES = [(f"<0x{b:02X}>", 0, "byte") for b in range(256)]
LETTERS = "abcdef<>/s0x1A▁"
UNIGRAM = HEAD + BYTES + [("[SEP]", 0, "user"), ("ab[", 0, "user"), ("xyz", -1, "unused"), ("abc", -0.5, "unused")]
UNIGRAM += [(c, -6 - 0.13 * i, "normal") for i, c in enumerate(LETTERS)]
UNIGRAM += [(p, -2.03 - 0.17 * i, "normal") for i, p in enumerate(["▁a", "ab", "bc", "▁ab", "cde", "</", "0x", "ef", "▁<s", "abcd"])]
MERGED = ["ab", "bc", "▁a", "abc", "▁ab", "de", "def", "<s", "abcd", "▁▁", "0x", "0x1", "</", "</s"]
BPE = HEAD + BYTES + [("[SEP]", 0, "user"), ("b[", 0, "user"), ("cd", 0, "user")]
BPE += [(p, -i, "unused" if p in ("abc", "</s") else "normal") for i, p in enumerate(MERGED)] + [(c, -50 - i, "normal") for i, c in enumerate(LETTERS)]


def texts(seed):
    rng = random.Random(seed)
    parts = ["a", "b", "c", "d", "e", "f", " ", "  ", "<s>", "</s>", "<unk>", "<0x0A>", "[SEP]", "[", "ab[", "b[", "cd", "xyz", "abc", "abcd", "é", "日", "🙂", "\n", "▁", "0x1"]
    return ["", " ", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000))]


@pytest.mark.parametrize("pieces, algorithm", [(UNIGRAM, 1), (BPE, 2)])
@pytest.mark.parametrize("prefix, extra", [(True, False), (False, False)])
@pytest.mark.parametrize("fallback", [True, False])
def test_models_of_all_kinds(tmp_path, pieces, algorithm, prefix, extra, fallback):
    path = tmp_path / "m.model"
    path.write_bytes(model([p for p in pieces if fallback or p[2] != "byte"], algorithm, fallback, prefix, extra))
    own, data = codec.Codec(str(path)), texts(algorithm)
    theirs = codec._library(str(path)).encode(data)
    odd = [(t, a.tolist(), b) for t, a, b in zip(data, own.encode(data), theirs) if a.tolist() != b]
    assert not odd, (len(odd), odd[:3])
    assert own.library_ids(data) == theirs


def test_controls_are_spelled_out(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(model(UNIGRAM, 1))
    own = codec.Codec(str(path))
    assert own.model.algorithm == codec.UNIGRAM and not {0, 1, 2} & set(own.encode(["</s><s><unk>"])[0].tolist())


def test_long_texts_are_asked_in_parts(tmp_path, monkeypatch):
    path = tmp_path / "m.model"
    path.write_bytes(model(BPE, 2))
    own = codec.Codec(str(path))
    data = [t for t in texts(5) if t]
    whole = codec._library(str(path)).encode(data)
    monkeypatch.setattr(codec, "LONG", 4)
    assert own.library_ids(data) == whole
