"""Best-fit packing by bin completion.

Lengths are whole numbers up to the capacity, so the whole corpus is a histogram
of at most ``capacity`` counts.  The driver packs that histogram: best-fit
decreasing is the first incumbent, and where that needs more sequences than a
lower bound, a branch and bound over bin completions looks for fewer: around the
largest length left it enumerates undominated fillings, least waste first, cuts
branches whose waste is out of reach, and goes back to try others, within a
budget of steps.  The patterns are bounded by ``capacity`` (some times it) at
any corpus size; each document then finds its place from its rank among those of
its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrid.llm.common import per_worker, texts
from labelgrid.llm.wordbpe import WordBpe
from labelgrid.plans.materialize import materialize

CAPACITY = 4096
END_ID = 1
#: Steps for one list of fillings, and for the whole search; with those used up the best plan so far stands.
STEPS, BUDGET = 500, 200_000
#: Fillings tried around one length.
TRIED = 8


# -- the plan -----------------------------------------------------------------


def fillings(room: int, sizes: list[int], counts: dict[int, int], steps: int, keep: int = 1) -> tuple[list[tuple[int, ...]], int]:
    """Undominated multisets of ``sizes`` (ascending) for ``room``, least waste first, at most ``keep``; and the steps it took.

    Best fit (always the largest that fits) is the first incumbent.  A branch stops when even filling
    the rest of the room with what is left could not beat the incumbents' waste.
    """
    reach = [0]  # what all smaller sizes hold together
    for s in sizes:
        reach.append(reach[-1] + s * counts[s])
    space, best = room, []
    for s in reversed(sizes):
        n = min(space // s, counts[s])
        best += [s] * n
        space -= s * n
    found = {tuple(best): space}
    worst = space if keep == 1 else room + 1  # waste that a new filling must stay under
    # A step decides how often one size is taken, most first: room, sizes below, what is chosen, least size passed over.
    stack, given = [(room, len(sizes), (), room + 1, None)], steps
    while stack and steps > 0 and worst > 0:
        space, top, chosen, least, times = stack.pop()
        steps -= 1
        if times is None:
            if space - reach[top] >= worst:
                continue
            top = bisect_right(sizes, space, 0, top) - 1
            while top >= 0 and counts[sizes[top]] <= 0:
                top -= 1
            if top < 0:
                if space < least and space < worst:
                    filling = tuple(s for s, n in chosen for _ in range(n))
                    if undominated(filling, space, sizes, counts):
                        found[filling] = space
                        if len(found) > keep:
                            found.pop(max(found, key=found.get))
                        if len(found) == keep:
                            worst = max(found.values())
                continue
            times = min(counts[sizes[top]], space // sizes[top])
        s = sizes[top]
        if times > 0:
            stack.append((space, top, chosen, least, times - 1))
        passed = least if times == counts[s] else min(least, s)
        stack.append((space - s * times, top, (*chosen, (s, times)) if times else chosen, passed, None))
    return sorted(found, key=found.get), given - steps


def undominated(chosen: tuple[int, ...], waste: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """No left-out size can take the place of one or two chosen ones within the room (the larger piece dominates)."""
    used = Counter(chosen)
    groups = set(used) | {a + b for k, a in enumerate(chosen[:12]) for b in chosen[k + 1 : 12]}
    for g in groups:
        k = bisect_right(sizes, g + waste) - 1
        while k >= 0 and sizes[k] > g:
            if used[sizes[k]] < counts[sizes[k]]:
                return False
            k -= 1
    return True


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: each piece, largest first, into the fullest sequence that has room, or a new one.

    Sequences filled alike are one entry with their number.  Of those with the least room that will do, each takes pieces
    of a size until it has room for none, as it is then the fullest.
    """
    open_, rooms, out = {}, [], []  # room to (pattern, number); the rooms, ascending
    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                pattern, number = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, pattern, number = capacity, (), n
            each = min(room // s, n)
            some = min(number, n // each)
            n -= some * each
            if pattern and some < number:
                _add(open_, rooms, room, pattern, number - some)
            _add(open_, rooms, room - s * each, (*pattern, *[s] * each), some)
    for entries in open_.values():
        out += entries
    return out


def _add(open_, rooms, room, pattern, number):
    if room not in open_:
        open_[room] = []
        insort(rooms, room)
    open_[room].append((pattern, number))


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any plan needs: by volume, and with each length k up to half the capacity left out below k.

    Lengths over half the capacity stand alone, those over ``capacity - k`` take nothing of k or more, and what the
    others lack must hold the volume between k and the half.
    """
    sizes = np.array(sorted(histogram), "i8")
    counts = np.array([histogram[s] for s in sizes.tolist()], "i8")
    best = -(-int((sizes * counts).sum()) // capacity)
    large = 2 * sizes > capacity
    for k in {0, *sizes[2 * sizes <= capacity].tolist()}:
        partner = large & (sizes <= capacity - k)
        small = ~large & (sizes >= k)
        room = int((counts * (capacity - sizes))[partner].sum())
        best = max(best, int(counts[large].sum()) + max(0, -(-(int((counts * sizes)[small].sum()) - room) // capacity)))
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; every length is placed as often as it occurs."""
    histogram = {s: n for s, n in histogram.items() if n}
    full = histogram.pop(capacity, 0)  # a sequence each
    alone = [((capacity,), full)] if full else []
    return alone + (_complete(histogram, capacity, best_fit(histogram, capacity)) if histogram else [])


def _complete(histogram, capacity, best):
    """Depth-first bin completion from the incumbent ``best``; a decision is a filling and how often it is used.

    The first is used as often as the counts allow; going back, others follow, then each of them fewer times.  What a
    cut-off dive leaves is packed by best fit, so every dive ends in a plan.
    """
    limit, bound = sum(n for _, n in best), lower_bound(histogram, capacity)
    total = sum(s * n for s, n in histogram.items())
    counts, sizes = dict(histogram), sorted(histogram)
    used = waste = spent = 0
    path = []  # decisions taken: filling, times, and the choices left at that place

    def choices():
        """Yields fillings around the largest length with their times; those beyond the first cost a search of their own."""
        nonlocal spent
        top, seen = sizes[-1], []
        for keep in (1, TRIED):
            counts[top] -= 1
            found, steps = fillings(capacity - top, sizes, counts, STEPS, keep)
            counts[top] += 1
            spent += steps + len(sizes) // 4
            for f in found:
                around = (top, *f)
                if around not in seen:
                    seen.append(around)
                    yield around, min(counts[s] // n for s, n in Counter(around).items())
        for around in seen:
            for times in range(min(counts[s] // n for s, n in Counter(around).items()) - 1, 0, -1):
                yield around, times

    def take(around, times):
        nonlocal used, waste
        for s, n in Counter(around).items():
            counts[s] -= n * times
            if not counts[s] and times > 0:
                del sizes[bisect_left(sizes, s)]
            elif times < 0 and counts[s] == -n * times:
                insort(sizes, s)
        used += times
        waste += times * (capacity - sum(around))

    if limit == bound:
        return best
    left = choices()
    while True:
        decision = next(left, None)
        if decision and waste + decision[1] * (capacity - sum(decision[0])) <= (limit - 1) * capacity - total:
            path.append((*decision, left))
            take(*decision)
            rest = best_fit({s: counts[s] for s in sizes}, capacity) if spent > BUDGET and sizes else []
            if used + sum(n for _, n in rest) < limit and (rest or not sizes):
                best = [(f, n) for f, n, _ in path] + rest
                limit = used + sum(n for _, n in rest)
            if limit == bound or spent > BUDGET:
                return best
            if sizes:
                left = choices()
                continue
        elif decision:
            continue  # a sequence fewer is out of reach from here; other fillings or fewer times may do
        if not path:
            return best
        around, times, left = path.pop()
        take(around, -times)


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and where they go: ``sequence + k // uses``, ``offset + k % uses * length``."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for s in sorted(set(pattern), reverse=True):
            uses = pattern.count(s)
            rows.append((s, taken.get(s, 0), sequence, offset, uses))
            taken[s] = taken.get(s, 0) + uses * times
            offset += s * uses
        sequence += times
    rows.sort()
    cols = np.array(rows, "int64").reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "offset", "uses"), cols)) | {"key": cols[0] << 44 | cols[1]}


# -- the corpus ---------------------------------------------------------------

PIECES = "id {}, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document's ids, with their place among those of their length in the same task."""

    def cut(batches):
        bpe = per_worker(f"wordbpe {tokenizer_path}", lambda: WordBpe(tokenizer_path))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, "int64")
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column("id")
            rows = [[] for _ in range(6)]
            for k, raw in enumerate(bpe.encode(texts(batch, "text"))):
                raw += end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    got = raw[at : at + 4 * capacity]
                    size = len(got) // 4
                    for col, v in zip(rows, (k, n, at // 4, size, zlib.crc32(got), seen[size])):
                        col.append(v)
                    seen[size] += 1
            if rows[0]:
                k, n, start, size, crc, place = (np.array(c, "int64") for c in rows)
                yield pa.record_batch([ids.take(pa.array(k)), pa.array(n.astype("int32")), pa.array(start), pa.array(size), pa.array(crc), pa.array(np.full(len(k), part, "int32")), pa.array(place)], names=["id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return docs.mapInArrow(cut, PIECES.format(docs.schema["id"].dataType.simpleString()))


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids and an end id, packed: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only documents longer than the capacity are cut, into full pieces and a last one.  A NULL or empty text is the
    end id alone; repeated rows and NULL ids are packed like any others; an empty frame gives no rows.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = materialize(pieces(docs, tokenizer_path, capacity), "pieces")  # places in a task must not change from here on
    parts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    to = intervals(plan(histogram, capacity))
    ranked = cut.join(parts.select("length", "part", before.alias("before")), ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(to["key"], size << 44 | rank, "right") - 1
            k = rank - to["first"][at]
            sequence, offset = to["sequence"][at] + k // to["uses"][at], to["offset"][at] + k % to["uses"][at] * size
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    out = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
