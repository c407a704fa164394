"""Filling sequences of fixed length with texts: multiway differencing, batch by batch.

The texts never leave the task that scans them: a task counts tokens, gathers a bounded
batch of items, divides the batch into windows and emits a placement per item. There is
no shuffle and no key, hence no skew, and a task that is lost is redone alone.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers' files are on the driver, unless the caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
BATCH = 4096  #: items divided together
SWAPS = 4  #: of a window that is over capacity
TEXTS = 256  #: texts whose tokens are in memory at once
#: Fixed value: the pattern by which the rank files' tokenizer splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The rank file's tokenizer, loaded once per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Divides items into k parts of nearly equal sums; returns each item's part.

    Karmarkar-Karp: every item starts as a partition of one filled and k-1 empty slots,
    and the two partitions with the largest spread are merged again and again, the
    fullest slots of one on the emptiest of the other. Slots carry node numbers: a merged
    slot is a new node over two older ones, and the tree is read back at the end.
    """
    n = len(sizes)
    part = np.zeros(n, np.int64)
    if k <= 1 or n <= 1:
        return part
    left, right = np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int64)
    fresh = n + 1
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, s in enumerate(sizes):
        heap.append((-int(s), i, np.array([s], np.int64), np.array([i + 1], np.int64)))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        # Only filled slots are stored, fullest first; the rest of the k slots are empty.
        over = len(a) + len(b) - k
        if over <= 0:
            sums, nodes = np.concatenate([a, b]), np.concatenate([na, nb])
        else:
            # The `over` smallest of a meet the `over` smallest of b, opposed.
            at, bt = a[len(a) - over :], b[len(b) - over :]
            made = np.arange(fresh, fresh + over)
            left[fresh : fresh + over] = na[len(a) - over :]
            right[fresh : fresh + over] = nb[len(b) - over :][::-1]
            fresh += over
            sums = np.concatenate([a[: len(a) - over], b[: len(b) - over], at + bt[::-1]])
            nodes = np.concatenate([na[: len(a) - over], nb[: len(b) - over], made])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == k:  # only differences count: the common level is taken off
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, nodes))
        tie += 1
    _, _, _, nodes = heap[0]
    stack = [(int(x), p) for p, x in enumerate(nodes)]
    while stack:
        x, p = stack.pop()
        if x <= n:
            part[x - 1] = p
        else:
            stack += [(int(left[x]), p), (int(right[x]), p)]
    return part


def _relieved(sizes: np.ndarray, part: np.ndarray, k: int, capacity: int) -> np.ndarray:
    """Brings windows down to capacity: by swapping an item for a smaller one of a window with
    room, then by taking out the least that is enough and putting it where it leaves the least
    room. Returns the items that found none; they are in no window (-1)."""
    load = np.bincount(part, weights=sizes, minlength=k).astype(np.int64)
    for w in np.argsort(capacity - load, kind="stable"):
        for _ in range(SWAPS):
            over = load[w] - capacity
            if over <= 0:
                break
            mine = np.flatnonzero(part == w)
            less = sizes[mine][:, None] - sizes[None, :]
            spare = (capacity - load)[part][None, :] - less
            able = (less > 0) & (spare >= 0) & (part != w)[None, :]
            whole = able & (less >= over)
            if whole.any():
                i, j = divmod(int(np.where(whole, spare, capacity + 1).argmin()), len(sizes))
            elif able.any():
                i, j = divmod(int(np.where(able, less, 0).argmax()), len(sizes))
            else:
                break
            i, to = mine[i], part[j]
            load[w] -= sizes[i] - sizes[j]
            load[to] += sizes[i] - sizes[j]
            part[i], part[j] = to, w
    out: list[int] = []
    for w in np.flatnonzero(load > capacity):
        mine = np.flatnonzero(part == w)
        mine = mine[np.argsort(sizes[mine], kind="stable")].tolist()
        while load[w] > capacity:
            n = next((n for n, i in enumerate(mine) if sizes[i] >= load[w] - capacity), 0)
            i = mine.pop(n)
            load[w] -= sizes[i]
            out.append(i)
    left = []
    for i in sorted(out, key=lambda i: (-sizes[i], i)):
        room = capacity - load
        fits = np.flatnonzero(room >= sizes[i])
        part[i] = fits[room[fits].argmin()] if len(fits) else -1
        if len(fits):
            load[part[i]] += sizes[i]
        else:
            left.append(i)
    return np.array(sorted(left), np.int64)


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Each item's window; sizes are above 0 and at most the capacity.

    The count starts at the least possible, by volume and by the items of more than half a
    window. Where differencing leaves a window over capacity, items move to windows with
    room; what finds none is divided anew into further windows, so the count rises by that.
    """
    k = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    part = difference(sizes, k)
    left = _relieved(sizes, part, k, capacity)
    if len(left):
        part[left] = k + windows(sizes[left], capacity)
    return part


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken",
    batch: int = BATCH,
) -> DataFrame:
    """One row per piece of a text: id, piece, start, n_tokens, window.

    A text of at most `capacity` tokens is one piece (piece 0, start 0); a longer one is
    cut into pieces of exactly `capacity`, each a window of its own, and a rest. `window`
    is unique in the result, and the pieces of one window have at most `capacity` tokens.
    Null and empty texts come out with n_tokens 0 and a null window, as they need no
    room. Rows that share an id are placed apart, each as a text of its own. Other columns
    of df are not read. `batch` bounds the items divided together, in scan order, and with
    them memory and time; each batch has at most about one window more than its volume
    needs, which the README has figures for. The tokenizer's file is sent to the executors.
    """
    if not os.path.isfile(tokenizer):
        raise FileNotFoundError(f"no tokenizer file {tokenizer}")
    df.sparkSession.sparkContext.addFile(tokenizer)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, n_tokens int, window bigint"

    def place(frames: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        sent = SparkFiles.get(os.path.basename(tokenizer))
        enc = encoder(sent if os.path.isfile(sent) else tokenizer)
        base, used = TaskContext.get().partitionId() << 40, 0
        ids: list = []
        cols: tuple[list, list, list] = ([], [], [])

        def flush() -> Iterator:
            nonlocal used, ids, cols
            piece, start, size = (np.array(c, np.int64) for c in cols)
            window = np.full(len(ids), -1, np.int64)
            whole, rest = size == capacity, (size > 0) & (size < capacity)
            window[whole] = used + np.arange(whole.sum())
            used += int(whole.sum())
            if rest.any():
                part = windows(size[rest], capacity)
                window[rest] = used + part
                used += int(part.max()) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, out_type),
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(size, pa.int32()),
                    pa.array(base + window, mask=window < 0),
                ],
                names=[id_col, "piece", "start", "n_tokens", "window"],
            )
            ids, cols = [], ([], [], [])

        out_type = None
        for frame in frames:
            out_type = frame.schema.field(0).type
            for key, n in zip(frame.column(0).to_pylist(), _lengths(enc, frame.column(1)), strict=True):
                for at in range(0, max(n, 1), capacity):
                    ids.append(key)
                    cols[0].append(at // capacity)
                    cols[1].append(at)
                    cols[2].append(min(capacity, n - at))
                if len(ids) >= batch:
                    yield from flush()
        if ids:
            yield from flush()

    return df.select(F.col(id_col), F.col(text)).mapInArrow(place, schema)


def _lengths(enc, texts) -> Iterator[int]:
    """Tokens of each text, counted a few texts at a time by the tokenizer's own loop; null counts 0."""
    for at in range(0, len(texts), TEXTS):
        some = [t or "" for t in texts.slice(at, TEXTS).to_pylist()]
        yield from map(len, enc.encode_ordinary_batch(some, num_threads=1))


def cut_texts(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of the texts that pack() had to cut, once per row of theirs: only cut ones have a second piece."""
    return pieces.filter(F.col("piece") == 1).select(id_col)
