"""Removal of byte strings that repeat: suffix buckets, worked off one at a time, over a ranked cover sample.

Every window of ``length`` bytes is a suffix cut to that length. A cover sample of the positions is ranked
beforehand by the hash of the ``GRAM`` bytes there; the least rank inside a window names the window's bucket,
so equal windows always meet in one bucket and a bucket holds few others. Windows that follow one another in
a document mostly share their bucket and travel as one run with its bytes. Buckets of one run alone are left out.

A bucket with many runs (a passage of many documents, with other neighbours in each) is refined as in a radix
sort of suffixes: its windows are told apart by the distance to the sampled position, in blocks of 32, 16, ... 1
distances, and by the longer string that all windows of a block share. At each step a run falls into two parts or stays
whole, so the number of rows never grows beyond twice the runs; what still is in a large bucket goes to the next step.

A bucket is then worked off alone: its windows are put in order by the 64-bit digest of their full length, which settles
ties of any length, then by (doc_id, start), and each that was seen before is marked, once its bytes are found to be those of
the first one with its digest. Memory holds one bucket at a time.

A positional difference cover would sample about 14 % of all positions (8 of 57) where this content-defined
cover takes 3 %, with the same guarantee that two equal windows share a sampled position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tidy

LENGTH = 100
GRAM = 32
CHUNK = 256  # windows in one run at most
BITMAP = 27  # log2 of the bits of the map of repeated buckets
HOT = 1000  # a bucket with more runs than this is refined
HOT_BUCKETS = 100_000  # bound on the number of such buckets
HELD = 64 << 20  # bytes of runs that a task holds to find equal ones before they travel

MUL = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
PIECE = 1 << 16  # positions whose powers are kept at hand


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER, POWER_INVERSE = powers(BASE, PIECE + 1024), powers(BASE_INVERSE, PIECE + 1024)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MUL
    h ^= h >> np.uint64(29)
    h *= np.uint64(BASE)
    return h ^ (h >> np.uint64(32))


def digests(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit digest of every run of ``size`` bytes in uint8 data."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, PIECE):
        part = data[a : a + PIECE + size - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * POWER[: len(part)], out=total[1:])
        m = len(part) - size + 1
        out[a : a + m] = (total[size:] - total[:-size]) * POWER_INVERSE[:m]
    return mix(out)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values that follow one another, by doubling."""
    m, k = h, 1
    while 2 * k <= w:
        m, k = np.minimum(m[k:], m[:-k]), 2 * k
    return np.minimum(m[w - k :], m[: len(m) - w + k]) if w > k else m


def groups(raws: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in groups of about PIECE bytes; a long text is cut into parts that overlap, so that
    each of its windows lies in just one."""
    out, total = [], 0
    for i, raw in enumerate(raws):
        for at in range(0, len(raw) - length + 1, PIECE):
            out.append((i, at, raw[at : at + PIECE + length - 1]))
            total += len(out[-1][2])
            if total >= PIECE:
                yield out
                out, total = [], 0
    if out:
        yield out


def runs(group: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """(text, bucket, first window, windows, whether two of them can be equal) of each run in a group.

    Two windows of a run can only be equal if its gram stands at more places than the one that all windows
    share: before the run's last window, or behind its first one.
    """
    size = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    h, w = digests(data, GRAM), length - GRAM + 1
    m = window_min(h, w)
    new = np.empty(len(m) + 1, bool)  # a run begins here, or would behind the last
    np.not_equal(m[1:], m[:-1], out=new[1:-1])
    new[0] = new[-1] = True
    inside = np.ones(len(m), bool)
    for e in ends[:-1].tolist():  # windows across a border belong to no text
        inside[e - length + 1 : e] = False
        new[e - length + 1] = new[e] = True
    again = np.flatnonzero(((h[: len(m)] == m) & ~new[1:]) | ((h[w - 1 :] == m) & ~new[:-1]))
    first = np.flatnonzero(new)
    n = np.diff(first)
    first = first[:-1]
    if len(n) and n.max() > CHUNK:
        first = np.concatenate([np.arange(a, a + k, CHUNK) for a, k in zip(first, n)])
        n = np.diff(np.append(first, len(m)))
    twice = np.zeros(len(first), bool)
    twice[np.searchsorted(first, again, "right") - 1] = True
    ok = inside[first]
    first, n, twice = first[ok], n[ok], twice[ok]
    whose = np.searchsorted(ends, first, "right")
    text, offset = np.array([(i, at) for i, at, _ in group], np.int64).T
    return text[whose], m[first], first - (ends - size)[whose] + offset[whose], n, twice


def raw_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer(raw_of(text), np.uint8)


def repeated_buckets(docs: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap of the buckets that hold two windows or more, and the sorted list of the hot ones.

    Both are of bounded size. A bit set for another bucket only costs work; beyond the bitmap's capacity all
    buckets count as repeated, which is slower but as exact.
    """

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            for at in range(0, len(b), 500):
                out = [np.zeros(0, np.uint64)]
                for g in groups([raw_of(t) for t in b["text"].iloc[at : at + 500]], length):
                    _, m, _, _, twice = runs(g, length)
                    out += [m, m[twice]]
                m, n = np.unique(np.concatenate(out), return_counts=True)
                yield pd.DataFrame({"m": m.view(np.int64), "n": n})

    counts = docs.select("text").mapInPandas(names, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stored(counts, "buckets")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slot = F.col("m").bitwiseAND(F.lit((1 << BITMAP) - 1))
    words = counts.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros((1 << BITMAP) // 64, np.int64)
    bitmap[words["w"].to_numpy()] = words["bits"].to_numpy()
    hot = counts.where(F.col("n") > max(HOT, total // HOT_BUCKETS)).select("m").toArrow()["m"].to_numpy()
    return bitmap.view(np.uint64), np.sort(hot.view(np.uint64)) if len(hot) else np.zeros(0, np.uint64)


ROW = "key long, doc_id long, a long, n long, off int, context binary"


class First:
    """The runs of a task: of equal ones only the earliest travels, the others are marked at once. What it holds is
    bounded by bytes; beyond the bound the runs so far travel, and equal ones meet in their bucket."""

    def __init__(self, length: int) -> None:
        self.length, self.seen, self.bytes, self.marks = length, {}, 0, []

    def add(self, key: int, context: bytes, row: tuple) -> None:
        old = self.seen.get((key, context))
        if old is None:
            self.seen[key, context] = row
            self.bytes += len(context) + 200
            return
        if row[:2] == old[:2]:  # a repeated row starts no later
            return
        if row < old:
            self.seen[key, context], row = row, old
        self.marks.append((row[0], row[1], row[1] + row[2] + self.length - 1))

    def leave(self, last: bool = False) -> Iterator[pd.DataFrame]:
        if self.marks:
            m = merged(np.array(self.marks, np.int64))
            self.marks = []
            yield pd.DataFrame({"key": m[:, 0] * 31, "doc_id": m[:, 0], "a": m[:, 1], "n": m[:, 2] - m[:, 1], "off": 0, "context": None})
        if last or self.bytes > HELD:
            rows = list(self.seen.items())
            self.seen, self.bytes = {}, 0
            for at in range(0, len(rows), 20_000):
                part = rows[at : at + 20_000]
                doc, a, n, off = zip(*[v for _, v in part])
                key = np.array([k[0] for k, _ in part], np.uint64).view(np.int64)
                yield pd.DataFrame({"key": key, "doc_id": doc, "a": a, "n": n, "off": off, "context": [k[1] for k, _ in part]})


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (doc, a, z) in order, those of a document that touch or overlap joined."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    doc, a, z = spans.T
    # the farthest end so far within the document
    wide = (int(z.max()) + 1) if len(z) else 1
    order = np.cumsum(np.append(False, doc[1:] != doc[:-1]))
    far = np.maximum.accumulate(order * wide + z) - order * wide
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (a[1:] > far[:-1]))) if len(z) else np.zeros(0, int)
    return np.stack([doc[new], a[new], far[np.append(new[1:], len(z)) - 1]], axis=1) if len(z) else spans


def candidates(docs: DataFrame, kept, length: int, hot_ones: bool) -> DataFrame:
    """Runs of repeated buckets with their bytes: of the hot buckets or of all others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        bitmap, hot = kept.value
        first, low = First(length), np.uint64((1 << BITMAP) - 1)
        for b in batches:
            docs_, raws = b["doc_id"].tolist(), [raw_of(t) for t in b["text"]]
            for g in groups(raws, length):
                text, m, s, n, _ = runs(g, length)
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, m), len(hot) - 1)] == m
                    ok = is_hot if hot_ones else ~is_hot
                else:
                    ok = np.full(len(m), not hot_ones)
                slot = m & low
                ok = np.flatnonzero(ok & (((bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)) > 0))
                for i, k, a, c in zip(text[ok].tolist(), m[ok].tolist(), s[ok].tolist(), n[ok].tolist()):
                    context = raws[i][a : a + c + length - 1]
                    if not hot_ones:
                        first.add(k, context, (docs_[i], a, c, 0))
                        continue
                    # windows by the leftmost place of the bucket's gram inside
                    at = np.flatnonzero(digests(np.frombuffer(context, np.uint8), GRAM) == np.uint64(k))
                    place = at[np.searchsorted(at, np.arange(c))]
                    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist()
                    for x, y in zip(cut, [*cut[1:], c]):
                        first.add(k, context[x : y + length - 1], (docs_[i], a + x, y - x, int(place[x]) - x))
            yield from first.leave()
        yield from first.leave(last=True)

    return docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, ROW)


def refined(rows: DataFrame, length: int) -> list[DataFrame]:
    """Runs of hot buckets (off: from the first window to its gram), cut until no bucket is large."""
    spark, out = rows.sparkSession, []

    def split(bits: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tidy()
            first = First(length)
            for b in batches:
                if (done := b["context"].isna()).any():
                    yield b[done]
                for doc, a, n, off, context in b.loc[~done, ["doc_id", "a", "n", "off", "context"]].itertuples(index=False):
                    i = 0
                    while i < n:
                        block = (off - i) >> bits << bits  # distances from block on, 2 ** bits of them
                        z = min(n, off - block + 1)
                        shared = context[off - block : off - block + length + 1 - (1 << bits)]
                        first.add(xxhash.xxh64_intdigest(shared, block << 3 | bits), context[i : z + length - 1], (doc, a + i, z - i, off - i))
                        i = z
                yield from first.leave()
            yield from first.leave(last=True)

        return run

    for bits in range((length - GRAM).bit_length() - 2, -1, -1):
        parts = stored(rows.mapInPandas(split(bits), ROW), "refined")
        live = parts.where("context is not null")
        counts = live.groupBy("key").agg(F.count("*").alias("n"))
        total = live.count()
        hot = [] if bits == 0 else [r["key"] for r in counts.where(F.col("n") > max(HOT, total // HOT_BUCKETS)).select("key").collect()]
        if not hot:  # at the end a bucket holds one window, once for each task at most
            return [*out, parts]
        large = F.broadcast(spark.createDataFrame([(k,) for k in hot], "key long"))  # HOT_BUCKETS rows at most
        out += [live.join(large, "key", "left_anti").select(*parts.columns), parts.where("context is null")]
        rows = live.join(large, "key", "left_semi").select(*parts.columns)
    return out


def duplicated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, a, z): bytes a to z (exclusive) of a document, every window of which starts earlier elsewhere."""
    spark = docs.sparkSession
    bitmap, hot = repeated_buckets(docs, length)
    kept = spark.sparkContext.broadcast((bitmap, hot))
    rows = candidates(docs, kept, length, False)
    if len(hot):
        for part in refined(candidates(docs, kept, length, True), length):
            rows = rows.unionByName(part)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            key = b["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield seen_before(b.iloc[:cut], length)
            rest = b.iloc[cut:]
        if rest is not None and len(rest):
            yield seen_before(rest, length)

    return rows.drop("off").repartition("key").sortWithinPartitions("key", "doc_id", "a").mapInPandas(compare, "doc_id long, a long, z long")


def window_digests(contexts: list[bytes], n: np.ndarray, length: int) -> np.ndarray:
    """Digests of the first n windows of each run, one run after the other."""
    out, size, at = [], n + length - 1, 0
    ends = np.cumsum(size)
    while at < len(n):
        z = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        data = np.frombuffer(b"".join(contexts[at:z]), np.uint8)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * POWER[: len(data)], out=total[1:])
        k = n[at:z]
        i = np.arange(k.sum()) + np.repeat(np.cumsum(size[at:z]) - size[at:z] - np.cumsum(k) + k, k)
        out.append(mix((total[i + length] - total[i]) * POWER_INVERSE[i]))
        at = z
    return np.concatenate(out)


def equal_windows(data: np.ndarray, own: np.ndarray, other: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at ``own``, ascending, and at ``other`` hold the same bytes. Neighbours that stand in step are compared as one stretch."""
    out = np.empty(len(own), bool)
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1] + 1) | (other[1:] != other[:-1] + 1))) if len(own) else np.zeros(0, int)
    n = np.diff(np.append(new, len(own)))
    ends = np.cumsum(n + length - 1)
    a = 0
    while a < len(new):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 16 * PIECE, "right")))
        k = n[a:z]
        size = k + length - 1
        at = np.cumsum(size) - size
        step = np.arange(size.sum())
        same = data[np.repeat(own[new[a:z]] - at, size) + step] == data[np.repeat(other[new[a:z]] - at, size) + step]
        first, last = new[a], new[a] + k.sum()
        if same.all():
            out[first:last] = True
        else:
            odd = np.append(0, np.cumsum(~same))
            i = np.arange(k.sum()) + np.repeat(at - np.cumsum(k) + k, k)
            out[first:last] = odd[i + length] == odd[i]
        a = z
    return out


def seen_before(b: pd.DataFrame, length: int) -> pd.DataFrame:
    """Marked spans of whole buckets, rows sorted by (key, doc_id, a). Windows of one digest are compared byte by byte."""
    done = b["context"].isna().to_numpy()
    spans = [np.stack([b["doc_id"].to_numpy()[done], b["a"].to_numpy()[done], (b["a"] + b["n"]).to_numpy()[done]], axis=1)]
    live = b[~done]
    if len(live):
        n = live["n"].to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        h = window_digests(live["context"].tolist(), n, length)
        # equal windows have one bucket, and a bucket's windows come by (doc_id, start)
        order = np.argsort(h, kind="stable")
        h = h[order]
        again = np.append(False, h[1:] == h[:-1])
        kept = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))[again]  # the first of each group of equal windows
        start = live["a"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        doc = live["doc_id"].to_numpy()[row]
        own, other = order[again], order[kept]
        # the bytes decide; where digests clash, all windows of the digest are told apart by them
        contexts = live["context"].tolist()
        data = np.frombuffer(b"".join(contexts), np.uint8)
        place = np.arange(len(row)) + (row * (length - 1))  # a run's bytes go length - 1 beyond its windows
        by = np.argsort(own)
        own, other = own[by], other[by]
        if not (same := equal_windows(data, place[own], place[other], length)).all():
            clash = np.isin(h, np.unique(h[again][by][~same]))
            keep = ~np.isin(own, order[clash])
            seen: dict = {}
            more = [(i, j) for i in order[clash].tolist() if (j := seen.setdefault(data[place[i] : place[i] + length].tobytes(), i)) != i]
            own, other = np.concatenate([np.stack([own[keep], other[keep]], axis=1), np.array(more, int).reshape(-1, 2)]).T
        own = own[(doc[own] != doc[other]) | (start[own] != start[other])]  # a repeated row starts no later
        spans.append(np.stack([doc[own], start[own], start[own] + length], axis=1))
    out = merged(np.concatenate(spans).astype(np.int64))
    return pd.DataFrame({"doc_id": out[:, 0], "a": out[:, 1], "z": out[:, 2]})


def cut_spans(text: str | None, spans: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The text's bytes, which of them go, and the number of maximal runs that go."""
    data = bytes_of(text)
    depth = np.zeros(len(data) + 1, np.int32)
    if spans is not None and len(spans):
        np.add.at(depth, [s["a"] for s in spans], 1)
        np.add.at(depth, [s["z"] for s in spans], -1)
    gone = np.cumsum(depth[:-1]) > 0
    return data, gone, int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary for every row of docs(doc_id, text).

    Null texts are empty; texts under ``length`` bytes lose nothing. Rows without a doc_id are kept whole and
    repeat for nobody. Repeated rows with one doc_id count as one document's text: the same spans go from each.
    Empty tables give an empty result. doc_id is a long; other columns are ignored.
    """
    spans = duplicated_spans(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, s in zip(b["doc_id"], b["text"], b["spans"]):
                data, gone, n = cut_spans(text, s)
                out.append((doc, len(data), int(gone.sum()), n, data[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.select("doc_id", "text").join(spans, "doc_id", "left").mapInPandas(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str], length: int) -> dict[int, tuple[int, int, int, str]]:
    """For tests: every window in a set, in order."""
    seen, out = set(), {}
    for doc in sorted(texts):
        data = (texts[doc] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        n = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), n, hashlib.sha256(kept).hexdigest())
    return out
