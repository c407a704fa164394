"""Evaluation passages inside training texts: an embedding of edits, sampled hashes, exact checks.

The evaluation items are few and known, the corpus is large, so the items are indexed and
every text is held against the index in the task that scans it. No text is shuffled; the
result has a row per leak. An item set beyond `block_chars` is worked off in blocks, each
small enough to broadcast.

Texts are compared as squeezed streams: folded, without anything but letters and digits.
Line breaks, also inside words, punctuation, spacing and markup are gone there.

1. Windows as long as the shortest passage that counts (`run` words of an item) begin at every
   word of the items and of the texts. A random walk reads each: at step t it puts out
   the character it stands on and a random bit, a function of t and the character,
   says whether it moves on. Strings a few edits apart soon fall into step again, so their
   edit distance becomes a Hamming distance between walks of equal length.
2. TABLES hashes, each of SAMPLES steps of a walk, find equal samples. A table draws its
   steps from the first part of the walk (SPANS), so that edits late in a window do not hurt.
3. All hits of a block of texts are checked at once: equal characters along a hit's diagonal
   give its whole item words. A run of them decides; else an item that has LEAST_WORDS of
   `stretch` words on its diagonals is aligned word by word with unit edit costs, and the
   alignment is searched for a long stretch with few edits.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.folding import fold_words

WALKS = 2  #: independent embeddings
SPANS = (0.75, 0.9)  #: part of the walk that each table of a walk samples
TABLES = WALKS * len(SPANS)
SAMPLES = 16  #: steps hashed by a table; the README has the recall measured with these
LEAST_WORDS = 0.4  #: share of a stretch's words that hits must have found before it is aligned
EDITS = 7  #: a stretch of n words may have n / EDITS edits (about one in eight, rounded up)
EXPAND = 400_000  #: hits looked at together
CHECKED = 200_000  #: item words compared together, few enough for a processor's cache
WALKED = 16_384  #: starts that walk together, as above
GRAMS = 8192  #: numbers that three characters are hashed to
_PAD = 512

#: Byte classes: letters and digits, with the bytes of other scripts' letters.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: White space and the ends of texts.
_GAPS = np.zeros(256, bool)
_GAPS[[0, 9, 10, 13, 32]] = True

_MIX = np.uint64(0x9E3779B97F4A7C15)


def squeeze(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Many texts as one stream: bytes, starts, each start's text, offsets of texts, spaced.

    A start is a letter or digit after anything else; it is spaced if there was white space,
    so the spaced ones begin what is written as a word. Texts are parted by zeros, many of
    them at the end.
    """
    raw = np.frombuffer("\0".join(texts).encode() + b"\0", np.uint8)
    keep = _ALNUM[raw]
    edges = np.flatnonzero(np.diff(keep, prepend=False, append=False))
    first, past = edges[::2], edges[1::2]  # of each run of letters and digits
    ends = np.flatnonzero(raw == 0)
    keep[ends] = True
    place = np.cumsum(keep, dtype=np.intp) - 1
    starts = place[first]
    offsets = np.concatenate([[0], place[ends] + 1])
    stream = np.concatenate([raw[keep], np.zeros(_PAD, np.uint8)])
    gaps = np.cumsum(_GAPS[raw], dtype=np.intp)
    spaced = gaps[first] > np.append(-1, gaps[past - 1])[: len(first)]
    return stream, starts, np.searchsorted(offsets, starts, "right") - 1, offsets, spaced


@dataclass(frozen=True)
class Walks:
    """Random bits of the walks and the steps each table samples; the same in every task."""

    bits: np.ndarray  # (walk, step, character)
    steps: tuple[tuple[frozenset[int], ...], ...]  # per walk and table

    @staticmethod
    def of(window: int, seed: int = 11) -> Walks:
        """Walks that stay inside a window of that many characters in 99 of 100 cases."""
        n = int(((-2.33 + math.sqrt(2.33**2 + 8 * window)) / 2) ** 2)
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (WALKS, n, 256)).astype(np.intp)
        bits[:, :, 0] = 0  # the end of a text is never left
        k = min(SAMPLES, n)
        steps = tuple(tuple(frozenset(rng.choice(max(k, int(n * x)), k, replace=False).tolist()) for x in SPANS) for _ in range(WALKS))
        return Walks(bits, steps)

    def hashes(self, stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """TABLES rows of hashes, one per start; starts are in order."""
        out = np.empty((TABLES, len(starts)), np.uint64)
        for a in range(0, len(starts), WALKED):
            some = starts[a : a + WALKED]
            here, move = np.empty((2, len(some)), np.intp)
            wide = stream[some[0] : some[-1] + self.bits.shape[1] + 1].astype(np.intp)  # as take() wants its places, so that no step converts them
            for w, tables in enumerate(self.steps):
                at = some - some[0]
                sampled = np.zeros((len(tables), len(some), -(-SAMPLES // 8) * 8), np.uint8)
                filled = [0] * len(tables)
                for t in range(1 + max(max(x) for x in tables)):
                    wide.take(at, out=here, mode="clip")
                    for k, x in enumerate(tables):
                        if t in x:
                            sampled[k, :, filled[k]] = here
                            filled[k] += 1
                    self.bits[w, t].take(here, out=move, mode="clip")
                    at += move
                h = np.zeros((len(tables), len(some)), np.uint64)
                for part in np.moveaxis(sampled.view(np.uint64), 2, 0):
                    h ^= part
                    h *= _MIX
                    h ^= h >> np.uint64(29)
                    h *= _MIX
                    h ^= h >> np.uint64(32)
                out[w * len(tables) : (w + 1) * len(tables), a : a + len(some)] = h
        return out


@dataclass
class Item:
    key: object
    words: list[str]
    parts: list[bytes]
    stream: np.ndarray
    ends: np.ndarray  # where each word ends in the stream
    starts: np.ndarray
    heads: np.ndarray  # _grams of each word's first and last three characters; GRAMS for shorter words
    tails: np.ndarray


class Index:
    """Hashes of the windows of all items, and what the checks need of an item."""

    def __init__(self, items: list[tuple[object, str]], run: int = 14):
        texts = [fold_words(t).replace("\0", " ") for _, t in items]
        stream, starts, owner, offsets, spaced = squeeze(texts)
        starts, owner = starts[spaced], owner[spaced]
        self.items: list[Item] = []
        shortest = 64
        for n, (key, _) in enumerate(items):
            mine = starts[owner == n] - offsets[n]
            body = stream[offsets[n] : offsets[n + 1] - 1]
            ends = np.append(mine[1:], len(body))
            whole = body.tobytes()
            parts = [whole[a:b] for a, b in zip(mine, ends, strict=True)]
            words = [w.decode(errors="replace") for w in parts]
            grams, long = _grams(stream[offsets[n] : offsets[n + 1] + 2]), ends - mine >= 3
            heads, tails = np.where(long, grams[mine], GRAMS), np.where(long, grams[ends - 3], GRAMS)
            self.items.append(Item(key, words, parts, body, ends, mine, heads, tails))
            if len(mine) >= run:
                shortest = min(shortest, int((ends[run - 1 :] - mine[: len(mine) - run + 1]).min()))
        self.walks = Walks.of(max(shortest, 16))
        self.owner, self.place = owner, starts - offsets[owner]
        self.stream = stream
        self.first = np.searchsorted(owner, np.arange(len(items) + 1))  # of each item's words
        #: Of each word: where it begins in the stream, its length, its first character.
        self.begin = starts
        self.sizes = np.concatenate([x.ends for x in self.items]) - self.place if items else starts
        self.initial = stream[starts]
        #: By table: a sieve over the hashes, then hashes in order and the word starts they are of.
        self.tables = []
        for keys in self.walks.hashes(stream, starts):
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[keys >> np.uint64(44)] = True
            self.tables.append((sieve, keys[order], order))

    def candidates(self, stream: np.ndarray, starts: np.ndarray, doc: np.ndarray, doc_at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of distinct (text, item, shift) that share a hash; a text is never in two blocks.

        The number of hits is known before any is written out, so a passage that many items
        share costs time, not memory, but for the hits of one text.
        """
        hits = []
        for (sieve, known, slot), keys in zip(self.tables, self.walks.hashes(stream, starts), strict=True):
            near = np.flatnonzero(sieve[keys >> np.uint64(44)])
            lo = np.searchsorted(known, keys[near], "left")
            n = np.searchsorted(known, keys[near], "right") - lo
            hits.append((near[n > 0], lo[n > 0], n[n > 0], slot))
        weight = np.zeros(int(doc.max(initial=-1)) + 1, np.int64)
        for near, _, n, _ in hits:
            weight += np.bincount(doc[near], n, len(weight)).astype(np.int64)
        block = np.cumsum(weight) // EXPAND
        for b in np.unique(block[weight > 0]):
            out = []
            for near, lo, n, slot in hits:
                mine = block[doc[near]] == b
                at, a, m = near[mine], lo[mine], n[mine]
                who = np.repeat(at, m)
                known = slot[np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(a, m)]
                shift = starts[who] - doc_at[who] - self.place[known]
                # One number for text, item and shift; the shift is between -2^31 and 2^31.
                out.append((doc[who].astype(np.int64) * len(self.items) + self.owner[known]) * (1 << 32) + shift + (1 << 31))
            whole = np.unique(np.concatenate(out))
            pair, shift = whole >> 32, (whole & ((1 << 32) - 1)) - (1 << 31)
            yield pair // len(self.items), pair % len(self.items), shift

    def whole_words(self, stream: np.ndarray, offsets: np.ndarray, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, word of all items), in order, of the words that are unchanged in the text at a candidate's shift.

        Words are compared at their first characters, then on as far as they agree. The zero
        after a text ends every word, so only a word's beginning can lie outside the text.
        """
        count = self.first[item + 1] - self.first[item]
        word = np.arange(int(count.sum())) + np.repeat(self.first[item] - (np.cumsum(count) - count), count)
        at = np.repeat(offsets[doc] + shift, count) + self.place[word]
        same = np.flatnonzero(stream.take(at, mode="clip") == self.initial[word])
        row, word, at = np.repeat(np.arange(len(doc)), count)[same], word[same], at[same]
        inside = (at >= offsets[doc[row]]) & (at < offsets[doc[row] + 1])
        row, word, at = row[inside], word[inside], at[inside]
        left, there = self.sizes[word], self.begin[word]
        going = np.arange(len(word))
        bad = np.zeros(len(word), bool)
        k = 1
        while len(going := going[left[going] > k]):
            equal = stream[at[going] + k] == self.stream[there[going] + k]
            bad[going[~equal]] = True
            going = going[equal]
            k += 1
        return row[~bad], word[~bad]


def runs(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and length of each run of consecutive words of a row."""
    begin = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 1))
    return row[begin], np.diff(begin, append=len(row))


def _joined(words: list[str], item: Item) -> list[str]:
    """The text's words cut as the item's: broken ones joined, glued ones parted."""
    vocab = set(item.words)
    glued = {a + b: (a, b) for a, b in zip(item.words, item.words[1:])}
    out: list[str] = []
    n = 0
    while n < len(words):
        for k in (2, 3):
            w = "".join(words[n : n + k])
            if w in vocab and any(x not in vocab for x in words[n : n + k]):
                out.append(w)
                n += k
                break
        else:
            w = words[n]
            out += [w] if w in vocab else glued.get(w, (w,))
            n += 1
    return out


def close_stretch(item: Item, words: list[str], least: int, edits: int = EDITS) -> bool:
    """Whether the text's words hold at least `least` consecutive item words, one edit in `edits`.

    A full edit-distance table with unit costs, the text's ends free; along its best path
    each item word is kept or edited and each added word is charged to the place before
    the next item word. Then all stretches of that path are tried.
    """
    b = _joined(words, item)
    a = item.words
    n, m = len(a), len(b)
    ids = {w: k for k, w in enumerate(dict.fromkeys(a))}
    codes = np.array([ids.get(w, -1) for w in b])
    table = np.zeros((n + 1, m + 1), np.int64)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        up, row = table[i - 1], table[i]
        row[0] = i
        row[1:] = np.minimum(up[:-1] + (codes != ids[a[i - 1]]), up[1:] + 1)
        np.minimum(row, np.minimum.accumulate(row - steps) + steps, out=row)
    i, j = n, int(table[n].argmin())
    cost = np.zeros(n, np.int64)  # of an item word, with the words added after it
    while i > 0:
        if j and table[i, j] == table[i - 1, j - 1] + (codes[j - 1] != ids[a[i - 1]]):
            cost[i - 1] += codes[j - 1] != ids[a[i - 1]]
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + 1:
            cost[i - 1] += 1
            i -= 1
        else:
            cost[i - 1] += 1
            j -= 1
    return _has_stretch(cost, least, edits)


def _has_stretch(cost: np.ndarray, least: int, edits: int) -> bool:
    """Whether some `least` or more consecutive words cost at most one in `edits`."""
    if len(cost) < least:
        return False
    # (total cost) * edits - words, at the ends of a stretch, may not grow over it.
    level = np.concatenate([[0], np.cumsum(cost * edits - 1)])
    return bool((level[least:] <= np.maximum.accumulate(level[: len(level) - least])).any())


def leaks_of(index: Index, texts: list[str], run: int = 14, stretch: int = 30) -> set[tuple[int, int]]:
    """(number of the text, number of the item) of all leaks."""
    stream, starts, owner, offsets, spaced = squeeze(texts)
    found: set[tuple[int, int]] = set()
    for doc, item, shift in index.candidates(stream, starts, owner, offsets[owner]):
        pair = doc * len(index.items) + item
        edges = np.flatnonzero(np.diff(pair, prepend=-1))
        size = np.cumsum(index.first[item + 1] - index.first[item])
        begin = edges[np.diff(size[edges] // CHECKED, prepend=-1) > 0]
        for at, to in zip(begin, np.append(begin[1:], len(pair)), strict=True):  # whole pairs, of bounded size but for one pair's rows
            _check(index, (stream, starts, owner, offsets, spaced), doc[at:to], item[at:to], shift[at:to], run, stretch, found)
    return found


def _check(index, texts, doc, item, shift, run, stretch, found) -> None:
    """Adds the leaks among candidates, which are ordered by text and item, to found."""
    stream, _, _, offsets, _ = texts
    pair = doc * len(index.items) + item
    new = np.diff(pair, prepend=-1) != 0
    first, nth = np.flatnonzero(new), np.cumsum(new) - 1
    row, word = index.whole_words(stream, offsets, doc, item, shift)
    exact = np.zeros(len(first), bool)
    whose, length = runs(row, word)
    exact[nth[whose[length >= run]]] = True
    found.update(zip(doc[first[exact]].tolist(), item[first[exact]].tolist(), strict=True))
    # Pairs with enough of their item's words, found at any shift, within a stretch.
    least, far = math.ceil(LEAST_WORDS * stretch), len(index.begin) + stretch
    of = nth[row]
    open_ = ~exact & (np.bincount(of, minlength=len(first)) >= least)
    known = np.unique((of * far + word)[open_[of]])
    last = known[least - 1 :]
    near = last - known[: len(last)] < stretch
    ends = np.append(first[1:], len(pair))
    for n in np.unique(last[near] // far).tolist():
        d, k = int(doc[first[n]]), int(item[first[n]])
        if _aligned(index.items[k], texts, d, shift[first[n] : ends[n]], stretch):
            found.add((d, k))


def _grams(stream: np.ndarray) -> np.ndarray:
    """A number below GRAMS for the three characters at each place but the last two."""
    wide = stream.astype(np.intp)
    return (wide[:-2] * 1021 + wide[1:-1] * 31 + wide[2:]) % GRAMS


def _may_hold(item: Item, stream: np.ndarray, stretch: int) -> bool:
    """Whether a piece of text has enough of the item's words: one that is nowhere in it costs an edit in any alignment.

    A word can only be there if its first and its last three characters are.
    """
    seen = np.zeros(GRAMS + 1, bool)
    seen[GRAMS] = True
    seen[_grams(stream)] = True
    if not _has_stretch(1 - (seen[item.heads] & seen[item.tails]), stretch, EDITS):
        return False
    piece = stream.tobytes()
    return _has_stretch(np.array([w not in piece for w in item.parts], np.int64), stretch, EDITS)


def _aligned(item: Item, texts, d: int, shifts: np.ndarray, stretch: int) -> bool:
    """Whether text d has a close stretch of the item near one of the shifts, by words as written or as spelt."""
    stream, starts, owner, offsets, spaced = texts
    lo_at, hi_at = np.searchsorted(owner, [d, d + 1])
    mine = starts[lo_at:hi_at] - offsets[d]
    whole, done = stream[offsets[d] : offsets[d + 1] - 1].tobytes(), None
    slack = len(item.stream) // 4
    for s in np.sort(shifts).tolist():
        # Shifts that lie together are looked at in one piece of the text.
        if done is not None and s <= done:
            continue
        lo, hi = max(0, s - slack), s + slack + len(item.stream)
        done = s + slack // 2
        if not _may_hold(item, stream[offsets[d] + lo : offsets[d] + min(hi, len(whole))], stretch):
            continue
        for some in (mine[spaced[lo_at:hi_at]], mine):
            a, b = np.searchsorted(some, [lo, hi])
            ends = np.append(some[a + 1 : b], min(hi, len(whole)) if b == len(some) else some[b])
            near = [whole[x:y].decode(errors="replace") for x, y in zip(some[a:b], ends, strict=True)]
            if close_stretch(item, near, stretch):
                return True
    return False


@functools.lru_cache(maxsize=2)
def _index_of(broadcast_id: int, box: _Box) -> Index:
    return Index(*box.value)


class _Box:
    """A broadcast's items, equal to any other box so that the cache goes by the broadcast."""

    def __init__(self, value: list):
        self.value = value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Box)

    def __hash__(self) -> int:
        return 0


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "item_text",
    run: int = 14,
    stretch: int = 30,
    block_chars: int = 4_000_000,
    batch_chars: int = 1_000_000,
) -> DataFrame:
    """One row (doc_id, item_id) for each text that carries a passage of an item.

    A passage is `run` consecutive words of the item unchanged, or `stretch` or more of
    them with at most one in EDITS replaced, dropped or added. Null and empty texts and
    items leak nothing; repeated rows give repeated leaks; every copy of a text counts.
    Other columns are not read. An empty item table gives an empty result.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id), F.col(item_text)).filter(F.length(F.trim(item_text)) > 0)
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_chars))
    types = [docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = f"`{doc_id}` {types[0]}, `{item_id}` {types[1]}"
    kind = to_arrow_type(items.schema[item_id].dataType)
    out = None
    for n in range(blocks):
        block = items.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == n) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(([(r[0], r[1]) for r in block.collect()], run))
        found = docs.select(F.col(doc_id), F.col(text)).mapInArrow(
            _searcher(shared, kind, doc_id, item_id, run, stretch, batch_chars), schema
        )
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(shared, kind, doc_id: str, item_id: str, run: int, stretch: int, batch_chars: int):
    def search(frames: Iterator) -> Iterator:
        import pyarrow as pa

        index = _index_of(shared._jbid if hasattr(shared, "_jbid") else id(shared.value), _Box(shared.value))
        ids: list = []
        texts: list[str] = []
        size = 0
        types: list = []

        def flush() -> Iterator:
            nonlocal ids, texts, size
            found = sorted(leaks_of(index, texts, run, stretch))
            if found:
                kinds = types[0], kind
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d, _ in found], kinds[0]), pa.array([index.items[k].key for _, k in found], kinds[1])],
                    names=[doc_id, item_id],
                )
            ids, texts, size = [], [], 0

        for frame in frames:
            types = [frame.schema.field(0).type]
            for key, t in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                ids.append(key)
                texts.append(fold_words(t).replace("\0", " "))
                size += len(t)
                if size >= batch_chars:
                    yield from flush()
        if texts:
            yield from flush()

    return search
