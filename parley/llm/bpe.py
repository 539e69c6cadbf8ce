"""BPE encoding and decoding with a pair occurrence index.

Each pass over a partition collects the words it has not met and keeps an index of all positions at which a pair of the
vocabulary stands, ordered by word, rank and position. Words are independent, so the lowest active rank of every word is taken
at once: all its positions are merged, and the new pairs are filed under their ranks. The index of a long word is ordered by
rank alone: for every rank the list of its positions, and the active ranks come from a heap.

Defined results: a null text counts as empty and has no tokens; repeated rows are encoded each; a null id stays null; extra
columns are left out. A whole text is encoded; long texts are handled in runs that end at white space, where no token crosses.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parley.llm.common import CACHED_BYTES, documents, in_arrow, make_room, pieces, slices

#: Fixed value: white space of the tokenizer's \s, which is Unicode's White_Space.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Bytes of text that are encoded at once, entries of each of a worker's two caches, and places of the table of words met once.
PART_BYTES, CACHE_ENTRIES, MET_PLACES = 1 << 18, 80_000, 1 << 21
#: Words of one index, and the bits of an entry that are the position and the rank; longer words than ``CACHED_BYTES`` are not in it.
INDEX_WORDS, AT_BITS, RANK_BITS = 1 << 13, 20, 24
#: Marks that are a word of their own after a letter: all of ASCII but the apostrophe, which may begin an ending.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
ENCODED = "doc_id long, ids binary"
DECODED = "doc_id long, text string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Repeated(dict):
    """A cache of the words that are met again: most distinct words of a corpus come once, and an entry takes some 200 bytes."""

    def __init__(self):
        super().__init__()
        self.met, self.marks = bytearray(MET_PLACES), 0

    def settle(self, new: dict[bytes, bytes]) -> None:
        """Of the words of a pass those are kept that are not long and, as far as the hashes tell, were met in a pass before."""
        met, last, kept = self.met, MET_PLACES - 1, []
        for key in new:
            at = hash(key) & last
            if met[at]:
                if len(key) <= CACHED_BYTES:
                    kept.append(key)
            else:
                met[at] = 1
                self.marks += 1
        make_room(self, len(kept), CACHE_ENTRIES)
        self.update((key, new[key]) for key in kept[: CACHE_ENTRIES - len(self)])
        if 4 * self.marks > MET_PLACES:
            self.met, self.marks = bytearray(MET_PLACES), 0


class Codec:
    """A vocabulary with word ends: text to ids and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.by_rank: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.by_rank.append((a, b, c))
            self.merges[a, b] = (rank, c)
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + self.end] for x in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word = regex.compile(pattern.replace(r"\s", SPACE))
        self.left, self.right, self.new = np.array(self.by_rank, np.int64).reshape(-1, 3).T.copy()
        self.base = max(vocab.values()) + 1
        pairs = self.left * self.base + self.right
        self.rank_of = np.argsort(pairs)
        self.pairs = np.append(pairs[self.rank_of], -1)  # the last stands for what comes after all pairs
        #: Ranks whose new symbol is in no pair of a lower rank: nothing comes before what is left of them.
        ranks, lowest = np.arange(len(pairs)), np.full(self.base, len(pairs))
        for side in (self.left, self.right):
            np.minimum.at(lowest, side, ranks)
        self.at_once = lowest[self.new] > ranks
        self.inner_of, self.last_of = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        names = {i: t.encode() for t, i in [*vocab.items(), *self.special.items()]}
        self.names = [names.get(i, b"") for i in range(max(names) + 1)]
        self.four = [i.to_bytes(4, "little") for i in range(len(self.names))]
        self.chunks, self.words = Repeated(), Repeated()

    def normal(self, text: str) -> str:
        """Canonical composition, then lower case letter by letter, so a final sigma is no special case."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def plan(self, chunk: bytes) -> list[int | bytes]:
        """The words of a text without white space, and the ids of special tokens among them."""
        if chunk.isalpha():
            return [chunk.lower()]
        head = chunk.rstrip(MARKS)
        if head.isalpha():
            return [head.lower(), chunk[len(head) :]]
        out: list[int | bytes] = []
        for part in self.cut.split(chunk.decode()):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                text = self.normal(part)
                out += [text.encode()] if text.isalpha() else [w.encode() for w in self.word.findall(text)]
        return out

    def merged(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word, little-endian."""
        out = self.merged_long([w for w in words if len(w) > CACHED_BYTES])
        short = [w for w in words if len(w) <= CACHED_BYTES]
        for at in range(0, len(short), INDEX_WORDS):
            out.update(self.merged_short(short[at : at + INDEX_WORDS]))
        return out

    def entries(self, symbol: np.ndarray, after: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The entries of the index for the pairs at some positions: word, rank and position in one number."""
        left, right = symbol[at], symbol[after[at]]
        pair = left * self.base + right
        found = np.searchsorted(self.pairs[:-1], pair)
        hit = (self.pairs[found] == pair) & (left >= 0) & (right >= 0)
        at = at[hit]
        return word[at] << (AT_BITS + RANK_BITS) | self.rank_of[found[hit]] << AT_BITS | at

    def merged_short(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """The ids of at most ``INDEX_WORDS`` words, all taken at once; the symbol after the end of a word is -1, one that is gone -2."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        symbol = self.inner_of[data]
        symbol[end - 1] = self.last_of[data[end - 1]]
        symbol[end] = -1
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        word = np.repeat(np.arange(len(words)), size)
        index = self.entries(symbol, after, word, np.arange(len(data) - 1))
        while len(index):
            at, rank = index & ((1 << AT_BITS) - 1), index >> AT_BITS & ((1 << RANK_BITS) - 1)
            index = index[(symbol[at] == self.left[rank]) & (symbol[after[at]] == self.right[rank])]
            index.sort()
            listed, of = index >> AT_BITS, index >> (AT_BITS + RANK_BITS)
            start = np.flatnonzero(np.diff(of, prepend=-1))
            lowest = listed == np.repeat(listed[start], np.diff(start, append=len(index)))
            at, rank = index[lowest] & ((1 << AT_BITS) - 1), listed[lowest] & ((1 << RANK_BITS) - 1)
            # of positions that overlap every second is merged, from the left; of a rank that others may overtake only the first
            place = np.arange(len(at))
            chain = np.append(True, after[at[:-1]] != at[1:])[: len(at)]
            merge = (place - np.maximum.accumulate(np.where(chain, place, 0))) % 2 == 0
            first = np.diff(of[lowest], prepend=-1) != 0
            merge &= self.at_once[rank] | first
            left = index[~lowest]
            if not merge.all():
                left = np.append(left, index[lowest][~merge])
            at, rank = at[merge], rank[merge]
            gone = after[at]
            follow = after[gone]
            symbol[at], symbol[gone] = self.new[rank], -2
            after[at], before[follow] = follow, at
            ahead = before[at]
            ahead = ahead[(ahead >= 0) & (ahead != np.append(-1, at[:-1]))]  # a pair of two new symbols is filed once
            index = np.concatenate((left, self.entries(symbol, after, word, ahead), self.entries(symbol, after, word, at)))
        ids = symbol >= 0
        flat, cuts = symbol[ids].astype("<u4").tobytes(), (4 * np.cumsum(ids)[end]).tolist()
        return zip(words, map(flat.__getitem__, map(slice, [0, *cuts], cuts)))

    def merged_long(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words of any length, one position at a time."""
        symbol: list[int] = []
        first: list[int] = []
        for w in words:
            first.append(len(symbol))
            symbol += [self.inner[b] for b in w[:-1]]
            symbol += (self.last[w[-1]], -1)
        size = len(symbol)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        find, by_rank = self.merges.get, self.by_rank
        places: defaultdict[int, list[int]] = defaultdict(list)
        for at, found in enumerate(map(find, zip(symbol, symbol[1:]))):
            if found:
                places[found[0]].append(at)
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            at_rank = places.pop(rank, None)
            if not at_rank:
                continue
            left, right, new = by_rank[rank]
            at_rank.sort()
            for i, at in enumerate(at_rank):
                if symbol[at] != left or symbol[gone := after[at]] != right:
                    continue
                symbol[at], symbol[gone] = new, -2
                follow = after[at] = after[gone]
                before[follow] = at
                lower = False
                if found := find((symbol[last := before[at]], new)):
                    if (other := found[0]) not in places:
                        heapq.heappush(active, other)
                    places[other].append(last)
                    lower = other < rank
                if found := find((new, symbol[follow])):
                    if (other := found[0]) not in places:
                        heapq.heappush(active, other)
                    places[other].append(at)
                    lower |= other < rank
                if lower and i + 1 < len(at_rank):  # the lower rank comes before what is left of this one
                    places[rank] = at_rank[i + 1 :]
                    heapq.heappush(active, rank)
                    break
        out = {}
        for w, at in zip(words, first):
            ids = []
            while symbol[at] != -1:
                ids.append(symbol[at])
                at = after[at]
            out[w] = np.array(ids, "<u4").tobytes()
        return out

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that are not held; of their words those are encoded that are not held either."""
        plans = list(map(self.plan, chunks))
        words = self.words
        new = self.merged([w for w in {w for p in plans for w in p} if not isinstance(w, int) and w not in words])
        four = self.four
        out = {}
        for chunk, plan in zip(chunks, plans):
            ids = [four[w] if isinstance(w, int) else new.get(w) or words[w] for w in plan]
            out[chunk] = ids[0] if len(ids) == 1 else b"".join(ids)
        words.settle(new)
        return out

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        runs, counts = [], []
        for t in texts:
            before = len(runs)
            for part in pieces(folded(t)) if t else ():
                runs += part.split()
            counts.append(len(runs) - before)
        found = list(map(self.chunks.get, runs))
        missed = [i for i, ids in enumerate(found) if ids is None]
        new = self.learn(list({runs[i] for i in missed}))
        for i in missed:
            found[i] = new[runs[i]]
        self.chunks.settle(new)
        each = iter(found)
        return [b"".join(islice(each, n)) for n in counts]

    def decode(self, ids: bytes) -> str:
        """The names of the tokens with a space between them: this vocabulary states no decoder."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()


def folded(text: bytes) -> bytes:
    """A-Z in lower case, as the tokenizer has them anyway.

    Not where the text may hold a special token, or a combining mark (U+0300 to U+036F) that is composed with its letter first.
    """
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each document; ``vocabulary`` is a file that every worker has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for at, texts in slices(batch, most=PART_BYTES):
                ids = own.encode_all(texts)
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return in_arrow(documents(docs), run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of each row of ``encode``; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for at, ids in slices(batch, "ids", PART_BYTES):
                texts = [own.decode(x or b"") for x in ids]
                yield pa.record_batch([batch.column("doc_id").slice(at, len(ids)), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_arrow(encoded.select("doc_id", "ids"), run, DECODED)


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for at, texts in slices(batch, most=PART_BYTES):
                ids = own.encode_all(texts)
                back = [own.decode(x) for x in ids]
                cols = [batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array(back, pa.string())]
                yield pa.record_batch(cols, ["doc_id", "ids", "decoded"])

    return in_arrow(documents(docs), run, f"{ENCODED}, decoded string")
