"""SentencePiece models run by the tokenizers library: the model file is parsed here, its parts are rebuilt, parity is verified."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marker of white space, and the kinds of pieces in a model file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words whose ids a worker remembers; beyond it, it starts anew.
MEMORY = 600_000
#: Characters of a text that the sentencepiece library gets at once, about.
LONG = 1 << 18
#: A blank between two words.
_BLANK = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


# ---------------------------------------------------------------- the model file


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Field number, wire type and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"wire type {kind} is not expected in a model file")
                size = varint()
            if at + size > len(data):
                raise ValueError("the model file is cut off")
            yield tag >> 3, kind, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def parse(data: bytes) -> Model:
    out = Model()
    for number, kind, value in fields(data):
        if number == 1 and kind == 2:
            piece, score, sort = "", 0.0, NORMAL
            for n, _, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    sort = v
            out.pieces.append((piece, score, sort))
        elif number == 2 and kind == 2:
            for n, _, v in fields(value):
                if n == 3:
                    out.algorithm = v
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3 and kind == 2:
            for n, _, v in fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.add_dummy_prefix = bool(v)
                elif n == 4:
                    out.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    out.escape_whitespaces = bool(v)
    out.unk_id = next((i for i, p in enumerate(out.pieces) if p[2] == UNKNOWN), 0)
    if out.algorithm not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return out


# ---------------------------------------------------------------- the tokenizers pipeline


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces in the order in which the model joins them: by the joined piece's score."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    out = []
    for piece, s in score.items():
        for i in range(1, len(piece)):
            if piece[:i] in score and piece[i:] in score:
                out.append((-s, len(piece), i, piece[:i], piece[i:]))
    return [(a, b) for *_, a, b in sorted(out)]


def _lattice(model: Model) -> list[tuple[str, float]]:
    """Strings and scores of a unigram model by id. Only ordinary and user-defined pieces may match text; the others get strings that no text has.

    User-defined pieces have the score that the sentencepiece library gives them. Bytes of unknown characters are put in behind.
    """
    scores = [s for _, s, kind in model.pieces if kind == NORMAL] or [0.0]
    never = " " if model.escape_whitespaces else "\U0010ffff"
    out = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind == USER_DEFINED:
            out.append((piece, len(piece.encode()) * max(scores) - 0.1))
        else:
            out.append((piece, score) if kind == NORMAL else (f"{never}{i}", max(scores)))
    return out


def _unused(model: Model) -> dict[int, list[int]]:
    """For each unused piece of a BPE model the ids of what it is joined from; no text gets an unused piece."""
    ids = {p: i for i, (p, *_) in enumerate(model.pieces)}
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    parts: dict[str, list[str]] = {}
    for piece in (p for p, _, kind in model.pieces if kind == UNUSED):
        symbols = list(piece)
        while len(symbols) > 2:  # joined as the model would join it
            pairs = [(-score[x + y], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in score]
            if not pairs:
                break
            i = min(pairs)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        if len(symbols) == 2 and all(x in ids for x in symbols):
            parts[piece] = symbols

    def resolved(piece: str) -> list[int]:
        if model.pieces[ids[piece]][2] != UNUSED or piece not in parts:
            return [ids[piece]]
        return [i for p in parts[piece] for i in resolved(p)]

    return {i: resolved(p) for i, (p, _, kind) in enumerate(model.pieces) if kind == UNUSED}


def build(model: Model):
    """The normaliser, the model without one, and the decoder, as tokenizers objects."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    unk = model.pieces[model.unk_id][0]
    if model.algorithm == BPE:  # merges lead to ordinary pieces only, so the strings of others never come out
        core = models.BPE(vocab={p: i for i, (p, *_) in enumerate(model.pieces)}, merges=_merges(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram(_lattice(model), unk_id=model.unk_id, byte_fallback=False)
    tokenizer = Tokenizer(core)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])
    return normalizers.Sequence(steps), tokenizer


@lru_cache(2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Codec:
    """Encodes and decodes texts as the SentencePiece model in a file does.

    No piece goes on behind a white-space marker, so text is encoded word by word (markers and what follows them); the
    words of a batch that are new go to the tokenizers library in one multithreaded call, the others are remembered.
    A model that has pieces across words is given whole texts instead. User-defined pieces of a BPE model are cut out
    of the text first, the longest at each place.
    """

    def __init__(self, path: str, threads: int = 2, verify: bool = False):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        with open(path, "rb") as f:
            self.model = model = parse(f.read())
        self.path = path
        self.normaliser, self.tokenizer = build(model)
        self.plain = model.escape_whitespaces and not model.charsmap and not model.remove_extra_whitespaces
        across = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))
        self.words = re.compile("(?s).+" if across else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        own = sorted((p for p, _, kind in model.pieces if kind == USER_DEFINED and model.algorithm == BPE), key=len, reverse=True)
        self.fixed = {p: struct.pack("<I", i) for i, (p, _, kind) in enumerate(model.pieces) if p in own}
        self.cut = re.compile("(" + "|".join(map(re.escape, own)) + ")") if own else None
        self.bytes_at = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.unused = _unused(model) if model.algorithm == BPE else {}
        #: whether a long text may be given to the sentencepiece library in parts that begin at a blank
        self.parts = self.plain and model.add_dummy_prefix and not across
        #: whether the sentencepiece library is asked about each new word, and the words that it encodes differently
        self.asks = verify and self.parts and self.cut is None
        self.odd: set[str] = set()
        self.memory: dict[str, bytes] = {}
        self.table = [self._bytes(p, kind) for p, _, kind in model.pieces]

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:  # the same by plain string operations, without the library's alignments
            return (MARK if self.model.add_dummy_prefix else "") + text.replace(" ", MARK)
        return self.normaliser.normalize_str(text)

    def split(self, texts: Iterable[str]) -> list[list[str]]:
        """The texts' words; after this, memory holds the ids of all of them."""
        normal = [self.normalised(t) for t in texts]
        if self.cut is None:
            split = [self.words.findall(t) for t in normal]
        else:
            split = [[w for n, x in enumerate(self.cut.split(t)) for w in ([x] if n % 2 else self.words.findall(x))] for t in normal]
        if len(self.memory) > MEMORY:
            self.memory.clear()
        self.memory.update(self.fixed)
        new = list(set().union(*split).difference(self.memory))
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            ids = self._ids(part)
            self.memory.update((w, struct.pack(f"<{len(x)}I", *x)) for w, x in zip(part, ids))
            if self.asks:
                self.odd.update(w for w, x, y in zip(part, ids, self._asked(part)) if x != y)
        return split

    def _asked(self, words: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids of words: it puts a first marker back; markers alone are asked behind a letter."""
        library = _library(self.path)
        first = len(library.encode("x"))
        bare = [not w.strip(MARK) for w in words]
        ids = library.encode(["x" + w if b else w[1:] if w[:1] == MARK else w for w, b in zip(words, bare)], num_threads=1)
        return [x[first:] if b else x for x, b in zip(ids, bare)]

    def _ids(self, words: list[str]) -> list[list[int]]:
        if self.model.algorithm == UNIGRAM and self.model.byte_fallback:
            unk = self.model.unk_id
            out = []
            for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False)):
                out.append([x for i, (a, b) in zip(e.ids, e.offsets) for x in ([self.bytes_at[c] for c in w[a:b].encode()] if i == unk else [i])])
            return out
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        if self.unused:
            ids = [[y for x in own for y in self.unused.get(x, (x,))] for own in ids]
        return ids

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        """What the sentencepiece library makes of whole texts; very long ones go to it in parts that begin at a blank, if that changes nothing."""
        library = _library(self.path)
        if not self.parts or max(map(len, texts), default=0) <= LONG:
            return library.encode(texts, num_threads=1)
        out = []
        for t in texts:
            ids, at = [], 0
            while at < len(t) or not at:
                m = _BLANK.search(t, at + LONG) if len(t) - at > LONG else None
                end = m.start() if m else len(t)
                ids += library.encode(t[at:end])  # the blank before a part comes back as the prefix
                at = end + 1
            out.append(ids)
        return out

    def joined(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memory.__getitem__, words)), np.uint32)

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        return [self.joined(words) for words in self.split(texts)]

    def raw(self, ids: np.ndarray) -> bytes:
        text = b"".join(map(self.table.__getitem__, ids.tolist()))
        return text[1:] if self.model.add_dummy_prefix and text[:1] == b" " else text

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")

    def library_decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def mismatches(path: str, texts: list[str]) -> list[int]:
    """Which texts the sentencepiece library encodes or decodes differently."""
    codec, own = Codec(path), _library(path)
    ids = codec.encode(texts)
    return [i for i, (a, b) in enumerate(zip(ids, own.encode(texts, num_threads=1))) if a.tolist() != b or codec.decode(a) != own.decode(b)]


@lru_cache(2)
def _codec(path: str, threads: int, verify: bool = False) -> Codec:
    return Codec(path, threads, verify)


def _encoded(path: str, threads: int, verify: bool, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, threads, verify)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(lo, 256).to_pylist()]
                words = codec.split(texts)
                ids = [codec.joined(w) for w in words]
                crcs = [zlib.crc32(a) for a in ids]
                same: list = [None] * len(ids)
                if verify:
                    same = [not codec.odd or codec.odd.isdisjoint(w) for w in words]
                    ask = [i for i, c in enumerate(crcs) if not codec.asks or c % whole == 0]
                    for i, theirs in zip(ask, codec.library_ids([texts[i] for i in ask]) if ask else ()):
                        same[i] = same[i] and ids[i].tolist() == theirs
                back = [codec.raw(a) for a in ids]
                lead = 1 if codec.model.add_dummy_prefix else 0
                plain = texts if codec.plain else [codec.normalised(t)[lead:] for t in texts]
                trips = [b == p.replace(MARK, " ").encode() for b, p in zip(back, plain)]
                at = np.concatenate([[0], np.cumsum([len(a) for a in ids])])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32)))
                shown = pa.array([b.decode("utf-8", "replace") for b in back], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 256), pa.array(np.diff(at)), pa.array(crcs, pa.int64()), pa.array(trips), pa.array(same, pa.bool_()), shown, lists],
                    ["id", "n_ids", "ids_crc32", "round_trip", "parity", "decoded", "ids"],
                )

    return run


def encode_documents(docs: DataFrame, model: str, text: str = "text", id: str = "doc_id", threads: int = 2, verify: bool = True, whole: int = 8) -> DataFrame:
    """One row per row of docs: (id, n_ids, ids_crc32, round_trip, parity, decoded, ids).

    round_trip: decoding gives the normalised text again; parity (null unless verify): the sentencepiece library gives
    the same ids. It is asked about each new word (no piece of the model crosses words, so texts agree where their words
    do) and, for one in `whole` texts, chosen by the crc of their ids, about the whole text; about all whole texts, if
    the model changes blanks or characters, or has user-defined pieces or pieces across words. Texts over LONG
    characters go to it in parts that begin at a blank, where that changes nothing. Null and empty texts have no ids; their round trip is true. Null ids and repeated rows
    are encoded like others; an empty table gives an empty table; other columns are not looked at. Whole texts, one
    pass, no shuffle; a worker holds a few hundred texts and a bounded memory of words.
    """
    out = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_encoded(model, threads, verify, whole), "id long, n_ids long, ids_crc32 long, round_trip boolean, parity boolean, decoded string, ids array<int>")
    return out.withColumnRenamed("id", id)


def decode_documents(encoded: DataFrame, model: str, id: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, 1)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], ["id", "text"])

    return encoded.select(F.col(id).alias("id"), "ids").mapInArrow(run, "id long, text string").withColumnRenamed("id", id)
