"""Best-fit packing of tokenised documents into sequences by bin completion.

1. Tasks tokenise whole texts, add the end id, cut documents longer than a sequence (the first piece takes the remainder)
   and write one narrow row per piece. Each row has its rank among the pieces of that length in its task.
2. Only the histogram of lengths matters for packing: at most ``capacity`` rows, whatever the input. Bin completion with
   branch and bound packs the histogram: around the longest piece left it enumerates fillings that no other dominates, tries
   them in order of waste, and prunes branches whose waste exceeds what the best packing so far allows; the first
   incumbent is best-fit decreasing. A filling is applied as often as the counts allow, so packing a billion pieces takes
   as many steps as packing a thousand.
3. The ranks of pieces within their length, continued over tasks by a prefix sum of counts, say which slot of which
   sequence a piece takes. Slots are ranges of ranks, again at most a few per length, sent to all tasks.

Null texts count as empty: one piece that holds only the end id. Rows that repeat an id are documents of their own, each
with its pieces. Null ids are allowed. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import tokens
from tidewatch.llm.common import pick, small_batches, texts
from tidewatch.session import durable

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Work of the search: fillings looked at for one bin, and bins completed before it goes on with no further open node.
FILLINGS = 24
STEPS = 4000


# --- pieces -----------------------------------------------------------------------------------------

def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, task, rank (of this length in its task). Written once."""
    path = vocabulary or tokens.vocabulary_path(VOCABULARY)
    rows = pick(docs, doc_id=doc_id, text=text)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.byte_bpe(path)
        end = np.asarray([END_ID], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in small_batches(batches):
            index, columns = [], ([], [], [], [], [], [])
            for i, ids in enumerate(bpe.ids(texts(batch))):
                ids += end
                n = len(ids) // 4
                start, stop = 0, n % capacity or min(n, capacity)
                piece = 0
                while start < n:
                    index.append(i)
                    length = stop - start
                    for column, value in zip(columns, (piece, start, length, zlib.crc32(ids[4 * start:4 * stop]), task, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(index, pa.int64())),
                                              *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)
        del bpe
        tokens.forget()

    kind = dict(rows.dtypes)["doc_id"]
    return durable(rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"))


# --- the packing of a histogram ---------------------------------------------------------------------

Filling = tuple[int, ...]  # lengths beside the longest, descending


class Histogram:
    """Counts of lengths, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.counts)

    def take(self, filling: Filling, times: int) -> None:
        for n in filling:
            left = self.counts[n] - times
            if left:
                self.counts[n] = left
            else:
                del self.counts[n]
                self.lengths.pop(bisect.bisect_left(self.lengths, n))

    def longest_up_to(self, room: int) -> int:
        """Index of the longest length that fits, or -1."""
        return bisect.bisect_right(self.lengths, room) - 1


def times_possible(counts: dict[int, int], filling: Filling) -> int:
    return min(counts[n] // k for n, k in Counter(filling).items())


def best_fit(left: Histogram, longest: int, room: int) -> Filling:
    """The longest length that fits, again and again."""
    out, used = [], Counter({longest: 1})
    while (i := left.longest_up_to(room)) >= 0:
        while i >= 0 and left.counts[left.lengths[i]] <= used[left.lengths[i]]:
            i -= 1
        if i < 0:
            break
        n = left.lengths[i]
        out.append(n)
        used[n] += 1
        room -= n
    return tuple(out)


def dominated(a: Filling, b: Filling) -> bool:
    """Whether ``b`` is at least as good as ``a``: each length of b takes over a disjoint part of a whose sum it covers."""
    if sum(a) > sum(b):
        return False
    rest = list(b)
    for n in a:  # descending; into the tightest place
        fits = [i for i, r in enumerate(rest) if r >= n]
        if not fits:
            return False
        i = min(fits, key=lambda i: rest[i])
        rest[i] -= n
    return True


def fillings(left: Histogram, longest: int, room: int, most_waste: int) -> list[Filling]:
    """Undominated fillings of ``room`` with at most ``most_waste`` left over, least waste and fewest lengths first."""
    found: list[Filling] = []
    steps = 0

    def extend(chosen: list[int], room: int, used: Counter) -> None:
        nonlocal steps
        steps += 1
        i = left.longest_up_to(min(room, chosen[-1] if chosen else room))
        tried = 0
        while i >= 0 and tried < 4 and len(found) < 4 * FILLINGS and steps < 40 * FILLINGS:
            n = left.lengths[i]
            if used[n] < left.counts[n]:
                tried += 1
                used[n] += 1
                extend([*chosen, n], room - n, used)
                used[n] -= 1
            i -= 1
        if not tried and room <= most_waste:
            found.append(tuple(chosen))

    extend([], room, Counter({longest: 1}))
    exact = left.counts.get(room, 0) - (room == longest)
    if exact > 0:
        return [(room,)]  # one length that fills the room dominates all else
    # Pairs that fill the room exactly, which the walk from the longest length may miss.
    for n in left.lengths[left.longest_up_to(room)::-1] if left.longest_up_to(room) >= 0 else []:
        if 2 * n < room or len(found) >= 5 * FILLINGS:
            break
        other = room - n
        need = Counter((longest, n, other))
        if other in left.counts and all(left.counts[k] >= c for k, c in need.items()):
            found.append((n, other))
    found.append(best_fit(left, longest, room))
    found = sorted({f for f in found if room - sum(f) <= most_waste}, key=lambda f: (-sum(f), len(f), tuple(-n for n in f)))[:FILLINGS]
    kept: list[Filling] = []
    for f in found:
        if not any(dominated(f, k) for k in kept):
            kept.append(f)
    return kept


Packing = list[tuple[Filling, int]]  # whole fillings, the longest first, and how often each is used


def bins(packing: Packing) -> int:
    return sum(times for _, times in packing)


def greedy(left: Histogram, capacity: int) -> Packing:
    """Best-fit decreasing."""
    out: Packing = []
    while left.lengths:
        longest = left.lengths[-1]
        whole = (longest, *best_fit(left, longest, capacity - longest))
        times = times_possible(left.counts, whole)
        left.take(whole, times)
        out.append((whole, times))
    return out


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can do without. For every size a: pieces above capacity - a stand alone, other pieces above
    half stand apart, and pieces from a to half fill the room those leave before they need sequences of their own."""
    n = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        n[length] = count
    number, size = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(half + 1)
    room = (number[capacity - a] - number[half]) * capacity - (size[capacity - a] - size[half])
    small = size[half] - np.where(a > 0, size[a - 1], 0)
    return int((number[capacity] - number[half] + np.maximum(0, -((room - small) // capacity))).max())


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """Bin completion, depth first within STEPS completed bins; best-fit decreasing is the first incumbent.

    An open node is only its path from the root: (filling, times, path before) or None, and the waste so far. What is left
    there is found again by taking the path from the counts.
    """
    total = sum(n * c for n, c in counts.items())
    least = least_bins(counts, capacity)
    best = greedy(Histogram(counts), capacity)
    steps, stack = 0, [(None, 0)]
    while stack and bins(best) > least and steps < STEPS:
        path, waste = stack.pop()
        most = (bins(best) - 1) * capacity - total  # what a better packing may waste
        if waste > most:
            continue
        left, steps = Histogram(counts), steps + 1
        for whole, times in unwound(path):
            left.take(whole, times)
        while left.lengths and waste <= most:
            steps += 1
            longest = left.lengths[-1]
            options = [(longest, *f) for f in fillings(left, longest, capacity - longest, most - waste)]
            if not options:
                break
            stack.extend(((other, 1, path), waste + capacity - sum(other)) for other in reversed(options[1:3]))
            whole = options[0]
            lost = capacity - sum(whole)
            times = times_possible(left.counts, whole)
            if lost:
                times = min(times, max(1, (most - waste) // lost))
            left.take(whole, times)
            path, waste = (whole, times, path), waste + times * lost
        if not left.lengths and waste <= most:
            best = unwound(path)
    return best


def unwound(path: tuple | None) -> Packing:
    out: Packing = []
    while path:
        whole, times, path = path
        out.append((whole, times))
    return out[::-1]


# --- placing ----------------------------------------------------------------------------------------

def slots(packing: Packing, capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks per sequence, first sequence, offset), sorted: the pieces of a length in order of rank."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for filling, times in packing:
        offset = 0
        for n, k in sorted(Counter(filling).items(), reverse=True):
            rows.append((n, used[n], k, sequence, offset))
            used[n] += k * times
            offset += k * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = pieces(docs, doc_id, text, capacity, vocabulary)
    per_task = rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(pack_histogram(counts, capacity), capacity)
    ranked = rows.join(bases, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("task", "base")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 41) + table[:, 1]  # lengths below 2^22, ranks below 2^41
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 41) + rank, "right") - 1
            _, first, each, sequence, offset = table[at].T
            turn, place = np.divmod(rank - first, each)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(sequence + turn), pa.array(offset + place * length)], names)

    kind = dict(rows.dtypes)["doc_id"]
    return ranked.select(*names[:5], "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
