"""Best-fit packing of token pieces by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, portions, save

#: The white space of the byte-level pattern, and the pattern itself, for ASCII and for all texts.
WHITE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = r"'(?:[stmd]|re|ve|ll)| ?[L]+| ?[N]+| ?[^WLN]+|[W]+(?![^W])|[W]+"
ASCII_WORDS = re.compile(WORDS.replace("W", " \\t-\\r").replace("L", "A-Za-z").replace("N", "0-9"))
ALL_WORDS = regex.compile(WORDS.replace("W", WHITE).replace("L", r"\p{L}").replace("N", r"\p{N}"))


@lru_cache(1)
def basic_words() -> re.Pattern:
    """ALL_WORDS for texts of the basic plane, its letters and numbers written out as ALL_WORDS sees them: `re` takes half of the time that `regex` does."""
    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    spans = lambda kind: "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(rf"\p{{{kind}}}+", plane))
    return re.compile(WORDS.replace("L", "<").replace("N", ">").replace("W", WHITE).replace("<", spans("L")).replace(">", spans("N")))


#: Characters of a text that are looked at at once; longer texts are cut where a word surely ends, whatever stands before or behind.
LONG = 1 << 16
WORD_END = regex.compile(r"(?<=\p{L})(?=[\s.,;:!?])")
#: Characters of texts whose new words go to the library together, about.
CALL = 1 << 20
#: Words whose ids a worker remembers (some 200 bytes each); beyond it, it starts anew.
MEMORY = 300_000
#: New words that go to the library as one text, a line each.
LINES = 2000
#: Pieces of one block, on which islands evolve; blocks are many, never larger.
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4


# ---------------------------------------------------------------- token pieces


def parts(text: str) -> Iterator[str]:
    """The text in parts whose ids, one after the other, are the text's: cut behind words, if it is long."""
    at = 0
    while len(text) - at > LONG and (m := WORD_END.search(text, at + LONG)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Encoder:
    """Token ids as the tokenizers library gives them, special tokens added to none.

    A byte-level vocabulary encodes each word (a match of its pattern) by itself. So texts are cut into words here, the
    words that a worker has not met go to the library, in one multithreaded call for many texts, and their ids are
    remembered. Of each new character the library is asked whether the pattern takes it for a letter, a number, white
    space or none of these; texts with a character that it sees in another way, or with a special token's name, and all
    texts under a file with other rules, go to the library whole.
    """

    def __init__(self, path: str, threads: int = 2, memory: int = MEMORY):
        self.most = memory
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules = spec.get("pre_tokenizer") or {}
        self.by_word = rules.get("type") == "ByteLevel" and rules.get("use_regex", True) and not rules.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.known: set[str] = set(map(chr, range(128)))
        self.strange: set[str] = set()
        self.memory: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        lo = room = 0
        for hi, text in enumerate(texts, 1):
            room += len(text)
            if room >= CALL or hi == len(texts):
                yield from self._encoded(texts[lo:hi])
                lo, room = hi, 0

    def words(self, text: str) -> list[str] | None:
        """The text's words, or None if it has to go to the library whole."""
        if not self.by_word or self.special.search(text):
            return None
        if text.isascii():
            return ASCII_WORDS.findall(text)
        met = set(text)
        if not met <= self.known:
            self._meet(met - self.known)
        if not self.strange.isdisjoint(met):
            return None
        return (basic_words() if max(met) <= "\uffff" else ALL_WORDS).findall(text)

    def _meet(self, characters: set[str]) -> None:
        cut = self.library.pre_tokenizer.pre_tokenize_str
        for c in characters:
            theirs = [len(cut(x + c + x)) == 1 for x in "a1!"]
            ours = [len(ALL_WORDS.findall(x + c + x)) == 1 for x in "a1!"]
            if theirs != ours:
                self.strange.add(c)
        self.known |= characters

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.memory) > self.most:
            self.memory.clear()
        every = [[(x, self.words(x)) for x in parts(t)] for t in texts]
        met = set().union(*(w for own in every for _, w in own if w is not None)).difference(self.memory)
        alone = [w for w in met if w.isspace()] + [x for own in every for x, w in own if w is None]
        self._ask(alone)
        self._ask_lines([w for w in met if not w.isspace()])
        ids = self.memory.__getitem__
        for own in every:
            yield np.frombuffer(b"".join([b"".join(map(ids, w)) if w is not None else ids(x) for x, w in own]), np.uint32)
        for x in alone:  # texts are not remembered
            if len(x) > LONG // 64:
                self.memory.pop(x, None)

    def _ask(self, texts: list[str]) -> None:
        self.memory.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(texts, self.library.encode_batch_fast(texts, add_special_tokens=False)))

    def _ask_lines(self, words: list[str]) -> None:
        """Words without white space behind their first character, many as lines of one text: a line end is always a word of its own."""
        parts_ = [words[lo : lo + LINES] for lo in range(0, len(words), LINES)]
        for part, e in zip(parts_, self.library.encode_batch(["\n".join(p) for p in parts_], add_special_tokens=False)):
            ids, number = np.array(e.ids, "<u4"), np.array(e.word_ids)
            if number[-1] != 2 * len(part) - 2:
                self._ask(part)
                continue
            raw, cut = ids.tobytes(), (4 * np.searchsorted(number, np.arange(2 * len(part)))).tolist()
            self.memory.update((w, raw[cut[2 * k] : cut[2 * k + 1]]) for k, w in enumerate(part))


@lru_cache(2)
def _encoder(path: str, memory: int) -> Encoder:
    return Encoder(path, memory=memory)


def _pieces(path: str, capacity: int, end: int, with_ids: bool, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = _encoder(path, memory), TaskContext.get().partitionId() << 40
        for batch in portions(batches):
            cols: list[list] = [[] for _ in range(7)]
            for id_, own in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(own, np.uint32(end)).astype("<u4")
                lead = len(ids) % capacity or capacity
                cuts = [0, *range(lead, len(ids) + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    for c, x in zip(cols, (row, id_, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype(np.int32) if with_ids else None)):
                        c.append(x)
                    row += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["row", "id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, text: str = "text", id: str = "doc_id", with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """Each document's ids and the end id, in pieces of at most `capacity`: (row, id, piece, start, length, ids_crc32, ids).

    Only longer documents are cut; the first piece takes what full pieces leave. row numbers the pieces uniquely.
    """
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_pieces(tokenizer, capacity, end, with_ids, memory), "row long, id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


# ---------------------------------------------------------------- the grouping genetic algorithm


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Martello and Toth's second bound on the number of bins."""
    s = np.sort(sizes.astype(np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    best = -(-int(total[-1]) // capacity)
    half = np.searchsorted(s, capacity // 2, "right")
    for k in np.unique(s[:half]):
        huge = np.searchsorted(s, capacity - k, "right")
        low = np.searchsorted(s, k, "left")
        room = (huge - half) * capacity - (total[huge] - total[half])
        best = max(best, len(s) - half + max(0, -(-int(total[half] - total[low] - room) // capacity)))
    return best


def best_fit(order: list[int], sizes: list[int], assign: np.ndarray, fills: list[int], capacity: int) -> None:
    """Put items into the fullest bins with room, opening bins where there are none. Free space is found in a bit mask."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fills):
        free[capacity - f].append(b)
        mask |= 1 << (capacity - f)
    for i in order:
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        fills[b] += size
        assign[i] = b
        free[room - size].append(b)
        mask |= 1 << (room - size)


def fitness(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    fills = np.bincount(assign, weights=sizes)
    return -len(fills), float(np.mean((fills / capacity) ** 2))


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator, share: float = 0.3) -> np.ndarray:
    """Whole well-filled bins of b go into a; bins of a that hold their items are dissolved; what they lose is best-fitted."""
    fills = np.bincount(b, weights=sizes)
    chance = (fills / capacity) ** 4 * share * 1.5
    given = rng.random(len(fills)) < chance
    inside = given[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[inside]] = True
    return _refilled(a, b, inside, hit, sizes, capacity)


def mutation(a: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The emptiest bins and a few others are dissolved and best-fitted again."""
    fills = np.bincount(a, weights=sizes)
    hit = rng.random(len(fills)) < 0.03
    hit[np.argsort(fills)[: max(2, len(fills) // 50)]] = True
    return _refilled(a, a, np.zeros(len(a), bool), hit, sizes, capacity)


def _refilled(a: np.ndarray, b: np.ndarray, inside: np.ndarray, hit: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    child = np.full(len(a), -1, np.int64)
    stay = ~hit[a] & ~inside
    _, kept = np.unique(a[stay], return_inverse=True)
    child[stay] = kept
    n = int(kept.max()) + 1 if len(kept) else 0
    _, new = np.unique(b[inside], return_inverse=True)
    child[inside] = new + n
    n += int(new.max()) + 1 if len(new) else 0
    loose = np.flatnonzero(child < 0)
    fills = np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=n).astype(int).tolist() if n else []
    loose = loose[np.argsort(-sizes[loose], kind="stable")]
    best_fit(loose.tolist(), sizes.tolist(), child, fills, capacity)
    return child


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, bound: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Generations of tournaments, crossover and mutation; stops when a packing reaches the lower bound, which nothing beats."""
    scored = sorted(((fitness(p, sizes, capacity), i, p) for i, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for _ in range(generations):
        if -scored[0][0][0] <= bound:
            break
        young = []
        for _ in range(len(scored)):
            x, y = (min(rng.integers(len(scored), size=2)) for _ in range(2))
            child = crossover(scored[x][2], scored[y][2], sizes, capacity, rng)
            if rng.random() < 0.5:
                child = mutation(child, sizes, capacity, rng)
            young.append((fitness(child, sizes, capacity), -1, child))
            if -young[-1][0][0] <= bound:
                break
        scored = sorted([*scored, *young], key=lambda x: (x[0], -x[1]), reverse=True)[: len(scored)]
    return [p for _, _, p in scored]


_STATE = "block long, island int, rows array<long>, sizes array<int>, packings array<array<int>>, bins int, bound int, elite boolean"


def _state(block: int, island: int, rows, sizes, population, bound, elite: bool = False) -> dict:
    return {"block": block, "island": island, "rows": rows, "sizes": sizes.astype(np.int32), "packings": [p.astype(np.int32) for p in population], "bins": int(population[0].max()) + 1, "bound": bound, "elite": elite}


def _settled(capacity: int):
    """The first population of an island: best fit by falling size, and by sizes in some disorder."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        rows, sizes = pdf["row"].to_numpy(), pdf["length"].to_numpy()
        rng = np.random.default_rng([abs(int(key[0])), int(key[1])])
        bound, population = lower_bound(sizes, capacity), []
        for n in range(POPULATION):
            noise = 1 if n == 0 and key[1] == 0 else 1 + rng.normal(0, 0.05 * (n + 1), len(sizes))
            packing, fills = np.empty(len(sizes), np.int64), []
            best_fit(np.argsort(-sizes * noise, kind="stable").tolist(), sizes.tolist(), packing, fills, capacity)
            population.append(packing)
            if len(fills) <= bound:
                break
        population = evolve(population, sizes, capacity, bound, GENERATIONS, rng)
        return pd.DataFrame([_state(key[0], key[1], rows, sizes, population, bound)])

    return run


def _met(capacity: int, epoch: int):
    """An island after the elite of its neighbour has come."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("elite")
        sizes = np.asarray(pdf["sizes"].iloc[0], np.int64)
        population = [np.asarray(p, np.int64) for _, x in pdf.iterrows() for p in (x["packings"][:1] if x["elite"] else x["packings"])]
        rng = np.random.default_rng([abs(int(key[0])), int(key[1]), epoch])
        population = evolve(population, sizes, capacity, int(pdf["bound"].iloc[0]), GENERATIONS, rng)[:POPULATION]
        return pd.DataFrame([_state(key[0], key[1], pdf["rows"].iloc[0], sizes, population, int(pdf["bound"].iloc[0]))])

    return run


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's best packing, each piece's bin and offset, and whether its bin is the block's emptiest."""
    for batch in batches:
        for block, rows, sizes, packing in zip(*(batch.column(i).to_pylist() for i in range(4))):
            bins, sizes = np.array(packing, np.int64), np.array(sizes, np.int64)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(sizes[order])
            starts = ends - sizes[order]
            first = np.flatnonzero(np.concatenate([[True], bins[order][1:] != bins[order][:-1]]))
            offset = np.empty(len(bins), np.int64)
            offset[order] = starts - np.repeat(starts[first], np.diff(np.append(first, len(bins))))
            loose = bins == np.bincount(bins, weights=sizes).argmin()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array((block << 32) + bins), pa.array(offset), pa.array(loose)], ["row", "length", "sequence_id", "offset", "loose"])


def _evolved(items: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """Places of pieces (row, length), packed block by block: (row, length, sequence_id, offset, loose)."""
    items = items.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "row", "length")
    islands = items.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
    state = save(islands.groupBy("block", "island").applyInPandas(_settled(capacity), _STATE), "islands")
    for epoch in range(EPOCHS):
        done = state.groupBy("block").agg((F.min("bins") <= F.min("bound")).alias("done"))
        live = state.join(done.where("not done").select("block"), "block", "left_semi")
        if live.isEmpty():
            break
        moved = live.unionByName(live.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")).withColumn("elite", F.lit(True)))
        rest = state.join(done.where("done").select("block"), "block", "left_semi")
        after = save(moved.groupBy("block", "island").applyInPandas(_met(capacity, epoch), _STATE).unionByName(rest), "islands")
        drop(state)
        state = after
    best = state.groupBy("block").agg(F.min_by(F.struct("rows", "sizes", F.col("packings")[0].alias("packing")), F.struct("bins", "island")).alias("best"))
    places = save(best.select("block", "best.rows", "best.sizes", "best.packing").mapInArrow(_laid_out, "row long, length long, sequence_id long, offset long, loose boolean"), "places")
    drop(state)
    return places


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """A place for each piece: pieces (unique row, length up to capacity, ...) with sequence_id and offset (gapless from 0).

    Full pieces are sequences of their own. The others are dealt by a hash to blocks of about BLOCK pieces, however
    many pieces there are; on each block ISLANDS populations evolve as tasks of their own, and after each epoch an
    island's elite migrates to the next. A block's best packing wins. An island stops once it has as few bins as the
    lower bound allows. What the emptiest bin of each block holds is dealt to blocks again, and those are packed in the
    same way, until there is one block: so the blocks' half-empty last bins don't add up. Every choice is seeded by
    block, island and epoch, so a lost task repeats its work exactly. An empty table gives an empty table.
    """
    part = pieces.where(F.col("length") < capacity)
    items, done, number = part.select("row", "length"), [], 0
    while True:
        blocks = max(1, math.ceil(items.count() / BLOCK))
        places = _evolved(items, blocks, capacity)
        settled = places.select("row", (F.col("sequence_id") + (number << 60)).alias("sequence_id"), "offset", "loose")
        number += 1
        if blocks == 1:
            done.append(settled.drop("loose"))
            break
        done.append(settled.where("not loose").drop("loose"))
        items = places.where("loose").select("row", "length")
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return part.join(reduce(DataFrame.unionByName, done), "row").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, text: str = "text", id: str = "doc_id", with_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """All documents in as few sequences as can be: one row per piece (id, piece, start, length, ids_crc32, sequence_id, offset).

    Null text is the empty text, whose one id is the end id. Null ids and rows that repeat an id are packed each on
    their own. Texts of any length are cut into full pieces and one shorter first piece. An empty table gives an
    empty table; other columns are not looked at. With with_ids the pieces' ids come too (see sequences).
    memory is the number of words whose ids a worker remembers: more cost memory, fewer cost time, the result is the same.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end, text, id, with_ids, memory)
    pieces = save(pieces if with_ids else pieces.drop("ids"), "pieces")
    return pack(pieces, capacity).drop("row").withColumnRenamed("id", id)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences' ids, from pack_documents(..., with_ids=True): (sequence_id, ids)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
