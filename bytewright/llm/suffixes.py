"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Candidates. Of the 120 81-byte strings in a string of 200 bytes, the one with the least hash, leftmost on ties, is its
anchor, so equal strings have equal anchors at the same place. The strings that start one after another with the same
anchor are a run, one text T of 200 to 319 bytes. A start can only repeat if another run has the same anchor. Runs
with the same T repeat as a whole; this is settled by T's hash, in each task first.

Sort. What is left are texts T that differ and share an anchor. Each task sorts their suffixes from the anchor on, and
hands them on as front-coded runs: the length of the prefix that a suffix shares with the one before, and the rest. A
range of anchors is merged by a loser tree that knows, for each contestant, how long a prefix it shares with the last
suffix given out: the longer one wins unseen, and only between equals are bytes compared, from there on. The merged
suffix array comes with its common prefixes.

Neighbours there share R bytes from the anchor on; with the L bytes that they share before it they repeat all starts
of their common string. Where a class has more than two members and some start is not settled by its neighbours,
though the common prefix would allow it, the class's strings of 200 bytes are compared as a whole.

Equal texts are handled once and have copies by count. Texts are shuffled twice: to cut out the runs' texts, and to
remove spans. A task holds the runs of its input split, and the members of one class at a time.

Defined cases: null texts are empty; texts below 200 bytes keep everything; matches never cross documents; repeated rows
are copies of each other, also with the same doc_id; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.llm.shingles import mixed, powers, prefix_hashes
from bytewright.plans.columns import pick
from bytewright.plans.scratch import forget, materialize
from bytewright.sources.tables import table

NAME = "op3_suffixes"
LENGTH, GRAM = 200, 81
_WIDE = LENGTH - GRAM + 1
_PART = 1 << 20  # bytes hashed at once; positions have 22 bits
_RUN = 100_000  # suffixes of a front-coded run


def runs_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the documents that ``offsets`` cut ``data`` into: anchor and T hashes, document, start in it, last start less
    the first, and the anchor's place in T."""
    m = len(data) - GRAM + 1
    if len(data) < LENGTH:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    up, down = powers(len(data))
    total = prefix_hashes(data, up)
    grams = mixed((total[GRAM:] - total[:-GRAM]) * down[:m])
    marked = np.full(-(-m // _WIDE) * _WIDE, np.uint64(0xFFFFFFFFFFFFFFFF))
    marked[:m] = (grams & ~np.uint64((1 << 22) - 1)) | np.arange(m, dtype=np.uint64)
    rows = marked.reshape(-1, _WIDE)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[: m - _WIDE + 1], ahead[_WIDE - 1 : m]) & np.uint64((1 << 22) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= offsets[doc + 1])
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    anchor = anchor[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    a, s, e = anchor[first], start[first], start[last]
    whole = (total[e + LENGTH] - total[s]) * down[s] + mixed((e - s).astype(np.uint64), 3)
    return grams[a], mixed(whole, 5), doc[s], s - offsets[doc[s]], e - s, a - s


def _runs(docs: DataFrame) -> DataFrame:
    """(anchor, t, h, at, kind): kind 0 a run of which the task has no other with the same T, or the first of these; 1
    one of those that repeat within the task. ``at`` packs start, span and anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def add(texts: list[bytes], keys: list[int], shift: list[int]) -> None:
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            anchor, t, doc, s, span, place = runs_in(np.frombuffer(b"".join(texts), np.uint8), offsets)
            held.append((anchor.view(np.int64), t.view(np.int64), np.array(keys, np.int64)[doc], (s + np.array(shift, np.int64)[doc]) << 16 | span << 8 | place))

        with np.errstate(over="ignore"):
            texts, keys, shift, size = [], [], [], 0
            for batch in batches:
                for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if h in seen or len(text) < LENGTH:
                        continue
                    seen.add(h)
                    for a in range(0, max(1, len(text) - LENGTH + 1), _PART):
                        piece = text[a : a + _PART + LENGTH - 1]
                        if size + len(piece) > 2 * _PART:
                            add(texts, keys, shift)
                            texts, keys, shift, size = [], [], [], 0
                        texts.append(piece)
                        keys.append(h)
                        shift.append(a)
                        size += len(piece)
            if texts:
                add(texts, keys, shift)
        if not held:
            return
        anchor, t, h, at = (np.concatenate(c) for c in zip(*held, strict=True))
        by = np.lexsort((t, anchor))
        anchor, t, h, at = anchor[by], t[by], h[by], at[by]
        first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (t[1:] != t[:-1])])
        more = ~first
        more[:-1] |= first[:-1] & ~first[1:]
        for mask, kind in ((first & ~more, 0), (first & more, 2), (more, 1)):
            i = np.flatnonzero(mask)
            for a in range(0, len(i), 100_000):
                p = i[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c[p]) for c in (anchor, t, h, at)] + [pa.array(np.full(len(p), kind, np.int32))], ["anchor", "t", "h", "at", "kind"])

    return docs.select("h", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "anchor long, t long, h long, at long, kind int")


def _classes(rows: DataFrame) -> DataFrame:
    """Of runs (kinds 0 and 2) in order of anchor, T, h, at: those whose anchor is not theirs alone. ``again``: T repeats;
    ``lone``: no other T has the anchor; ``rep``: the first of its T."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "t", "h", "at", "kind"]
        rest: list[np.ndarray] | None = None
        state = None  # anchor whose first T is already given out as not alone

        def judged(c: list[np.ndarray], *known: int | None) -> pa.RecordBatch:
            anchor, t, h, at, kind = c
            new_t = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (t[1:] != t[:-1])])
            new_a = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            group_t, group_a = np.cumsum(new_t) - 1, np.cumsum(new_a) - 1
            new_row = new_t | np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])])
            again = ((np.bincount(group_t, new_row) > 1) | (np.bincount(group_t, kind == 2) > 0))[group_t]
            shared = (np.bincount(group_a, new_t) > 1)[group_a]
            for a in known:
                if a is not None:
                    shared |= anchor == a
            keep = new_row & (again | shared)
            out = [x[keep] for x in (anchor, t, h, at, again, ~shared, new_t)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["anchor", "t", "h", "at", "again", "lone", "rep"])

        for batch in batches:
            c = [batch.column(n).to_numpy() for n in names]
            if rest is not None:
                c = [np.concatenate(x) for x in zip(rest, c, strict=True)]
            if not len(c[0]):
                continue
            # the last T waits for the next batch, and with it all of the last anchor if no other T of it has come
            last = c[0][-1]
            cut = int(np.searchsorted(c[0], last))
            inside = int(np.searchsorted(c[1][cut:], c[1][-1]))
            cut += inside
            if cut:
                yield judged([x[:cut] for x in c], state, last if inside else None)
            state = last if inside or state == last else None
            rest = [x[cut:] for x in c]
        if rest is not None and len(rest[0]):
            yield judged(rest, state)

    return rows.mapInArrow(run, "anchor long, t long, h long, at long, again boolean, lone boolean, rep boolean")


def _common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to ``at``."""
    n = min(len(a), len(b))
    while at < n and a[at : at + 32] == b[at : at + 32]:
        at += 32
    at = min(at, n)
    while at < n and a[at] == b[at]:
        at += 1
    return at


def front_coded(items: list[tuple[bytes, bytes]]) -> bytes:
    """Sorted (key, payload) pairs: shared length, rest of the key, payload."""
    out, before = [], b""
    for key, load in items:
        shared = _common(before, key)
        out.append(struct.pack("<HHH", shared, len(key) - shared, len(load)) + key[shared:] + load)
        before = key
    return b"".join(out)


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    at, key = 0, b""
    while at < len(blob):
        shared, rest, load = struct.unpack_from("<HHH", blob, at)
        at += 6
        key = key[:shared] + blob[at : at + rest]
        at += rest
        yield shared, key, blob[at : at + load]
        at += load


def merged(streams: list[Iterator[tuple[int, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes]]:
    """One sorted stream of several, each item with the length it shares with the one before. A loser tree over common
    prefixes: each contestant knows what it shares with the last item given out, so prefixes are compared once."""
    k = 1
    while k < len(streams):
        k *= 2
    now: list[tuple[bytes, bytes] | None] = [None] * k
    shared = [0] * k
    sources = [*streams, *(iter(()) for _ in range(k - len(streams)))]
    for i, source in enumerate(sources):
        if (item := next(source, None)) is not None:
            now[i] = item[1:]

    def play(i: int, j: int) -> tuple[int, int]:
        x, y = now[i], now[j]
        if x is None or y is None:
            return (j, i) if x is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        at = _common(x[0], y[0], shared[i])
        winner, loser = (i, j) if x[0][at:] <= y[0][at:] else (j, i)
        shared[loser] = at
        return winner, loser

    losers = [0] * k

    def first(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    top = first(1) if k > 1 else 0
    while now[top] is not None:
        key, load = now[top]
        yield shared[top], key, load
        item = next(sources[top], None)
        now[top], shared[top] = (None, 0) if item is None else (item[1:], item[0])
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def settled(members: list[tuple[int, bytes, bytes, bool]]) -> list[list[tuple[int, int]]]:
    """For each member of a class in suffix order, (shared with the one before, right, left, again): ranges of distances
    from start to anchor whose strings repeat in the class."""
    n = len(members)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    most = [0] * n
    for i in range(1, n):
        r = members[i][0]
        x, y = members[i - 1][2], members[i][2]
        l = _common(x[::-1], y[::-1])
        most[i - 1], most[i] = max(most[i - 1], r), max(most[i], r)
        if l + r >= LENGTH:
            found[i - 1].append((LENGTH - r, l))
            found[i].append((LENGTH - r, l))
    if n == 2:
        return found

    def open_(i: int) -> bool:
        low, high = LENGTH - most[i], len(members[i][2])
        for a, b in sorted(found[i]):
            if a > low:
                return True
            low = max(low, b + 1)
        return low <= high

    if not any(open_(i) for i in range(n) if not members[i][3]):
        return found

    def strings(i: int) -> Iterator[tuple[int, bytes]]:
        _, right, left, _ = members[i]
        for l in range(LENGTH - most[i], len(left) + 1):
            yield l, hashlib.blake2b(left[len(left) - l :] + right[: LENGTH - l], digest_size=16).digest()

    counts = Counter(s for i in range(n) for _, s in strings(i))
    for i in range(n):
        if not members[i][3] and open_(i):
            found[i] += [(l, l) for l, s in strings(i) if counts[s] > 1]
    return found


def _compared(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, a, b) of bytes that repeat, for runs whose T does not."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[bytes, bytes]] = []

        def out() -> pa.RecordBatch:
            items.sort()
            groups: dict[int, list] = {}
            for item in items:
                groups.setdefault(int.from_bytes(item[0][:8], "big") * parts >> 64, []).append(item)
            items.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int32()), pa.array([front_coded(g) for g in groups.values()], pa.binary())], ["range", "run"])

        for batch in batches:
            for h, text, runs in zip(*(batch.column(n).to_pylist() for n in ("h", "text", "runs")), strict=True):
                for r in runs:
                    s, span, place = r["at"] >> 16, r["at"] >> 8 & 255, r["at"] & 255
                    key = struct.pack(">Q", r["anchor"] & (1 << 64) - 1) + text[s + place : s + span + LENGTH]
                    items.append((key, struct.pack("<qq?", h, s + place, r["again"]) + text[s : s + place]))
            if len(items) >= _RUN:
                yield out()
        if items:
            yield out()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []

        def close(members: list, loads: list[tuple[int, int]]) -> None:
            if len(members) > 1:
                for (_, _, _, again), (h, a), ranges in zip(members, loads, settled(members), strict=True):
                    if not again:
                        rows.extend((h, a - high, a - low + LENGTH) for low, high in ranges)

        members, loads, anchor = [], [], b""
        for shared, key, load in merged([decoded(b) for b in part["run"]]):
            if key[:8] != anchor:
                close(members, loads)
                members, loads, anchor = [], [], key[:8]
            h, a, again = struct.unpack_from("<qq?", load)
            members.append((max(0, shared - 8) if members else 0, key[8:], load[17:], again))
            loads.append((h, a))
        close(members, loads)
        return pd.DataFrame(rows, columns=["h", "a", "b"])

    wanted = reps.groupBy("h").agg(F.collect_list(F.struct("anchor", "at", "again")).alias("runs"))
    texts = docs.join(wanted, "h").dropDuplicates(["h"]).select("h", F.encode("text", "UTF-8").alias("text"), "runs")
    runs = materialize(texts.mapInArrow(cut, "range int, run binary"), "suffix-runs")
    return runs.groupBy("range").applyInPandas(merge, "h long, a long, b long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs`` has h and text; returns (h, spans): unordered (a, b) byte ranges that repeat, by text."""
    runs = materialize(_runs(docs), "suffix-starts")
    dealt = runs.where("kind != 1").repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "anchor")
    classes = materialize(_classes(dealt.sortWithinPartitions("anchor", "t", "h", "at")), "suffix-classes")
    forget(docs.sparkSession)
    start, span = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255)
    whole = lambda df: df.select("h", start.alias("a"), (start + span + LENGTH).alias("b"))
    spans = whole(runs.where("kind = 1")).union(whole(classes.where("again"))).union(_compared(classes.where("not lone and rep"), docs))
    return materialize(spans.groupBy("h").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "suffix-spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` has doc_id and text; returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes left."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    spans = repeated_spans(docs.select("h", "text"))
    forget(docs.sparkSession)
    copies = docs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.lit(True).alias("copied"))
    marks = copies.join(spans, "h", "full")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for doc_id, text, copied, spans in zip(*(part.column(n).to_pylist() for n in ("doc_id", "text", "copied", "spans")), strict=True):
                    n = len(text)
                    if copied and n >= LENGTH:
                        spans = [{"a": 0, "b": n}]
                    kept, end, removed, count = [], 0, 0, 0
                    last = -1
                    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                        if a > last:
                            count += 1
                            kept.append(text[end:a])
                            removed += b - a
                            end = last = b
                        elif b > last:
                            removed += b - last
                            end = last = b
                    rest = b"".join([*kept, text[end:]])
                    rows.append((doc_id, n, removed, count, hashlib.sha256(rest).hexdigest(), rest))
                c = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = docs.join(marks, "h", "left").select("doc_id", F.encode("text", "UTF-8").alias("text"), F.coalesce("copied", F.lit(False)).alias("copied"), "spans")
    return whole.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(pick(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("kept")
