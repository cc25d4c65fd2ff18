"""SentencePiece encoding and decoding as relations.

Encoding: the texts' distinct words are taken apart into substrings of bounded length, which are joined with the
piece table; the edges so found are grouped by word, and Spark's ``aggregate`` folds each word's lattice to its
best path (Viterbi). A piece of rank r costs WEIGHT + log(r + 2), a Zipf-distributed unigram; a character
that no piece holds becomes its UTF-8 bytes. Words then replace their occurrences in the texts: the most frequent
ones from a file that every task maps into memory, all others by a join.

Decoding looks every id up in the piece table, laid out as one array of bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .common import ship, shuffle_partitions, stored, table, tidy
from .suffix_dedup import BASE, BASE_INVERSE, BYTES, mix, powers

SPACE = "▁"
LONG = 64  # characters; longer words are folded one by one outside the relations
LONG_CHARACTERS = 4_000_000  # of all long words together, up to which they go to every task too
FREQUENT = 4_000_000  # words whose ids every task gets, in some 90 MB at most; all others are joined
WORDS_A_TASK = 8_000
GROUP = 1 << 18  # bytes of texts that are cut into words at once
WEIGHT = 5.0  # of a piece whatever its rank; with it most words fall into the pieces that the library gives
BYTE_COST = 40.0

#: Kind of a character by the first byte of its UTF-8: 0 for the space, 2 for ASCII signs and digits and for the
#: blocks that hold most other signs, 1 for all else. No piece holds a border of words inside (encode checks that).
KIND = np.array([0 if b == 32 else 2 if b in (0xC2, 0xE2) or b < 128 and not chr(b).isalpha() else 1 for b in range(256)], np.uint8)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, id, cost of the model's normal pieces: a vocabulary file's fixed size."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)
    rows = [(m.id_to_piece(i), i, WEIGHT + math.log(2 - m.get_score(i))) for i in range(m.get_piece_size()) if not special(i)]
    return spark.createDataFrame(rows, "piece string, id int, cost double")


def byte_ids(path: str) -> list[int]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


class Words:
    """Words of a group of texts that lie end to end in ``data``: where each lies, and a 64-bit hash.

    A word is a run of spaces with the characters of one kind that follow, so the words of a text lie end to end too.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        self.data = data
        begin = np.append(0, ends[:-1])
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        kind = KIND[data[lead]]
        new = np.append(True, (kind[1:] != kind[:-1]) & (kind[:-1] != 0))[: len(lead)]
        new[np.searchsorted(lead, begin[begin < len(data)])] = True  # a text begins a word
        self.a = lead[new]
        self.z = np.append(self.a[1:], len(data))[: len(self.a)]
        self.first = np.searchsorted(self.a, begin)  # of each text
        self.last = np.append(self.first[1:], len(self.a))
        self.h = hashes(data, self.a, self.z)

    def others(self, first: np.ndarray) -> np.ndarray:
        """Words that share the hash of one of the given words (in order of their hashes), but not its bytes."""
        if not len(self.a):
            return self.a
        rep, n = first[np.searchsorted(self.h[first], self.h)], self.z - self.a
        wide = np.concatenate([np.zeros(8, np.uint8), self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(wide) - 7,), np.uint64, wide, 0, (1,))  # the eight bytes at each place
        head = eight[self.a + 8] & MASK[np.minimum(n, 8)]
        tail = np.where(n > 8, eight[self.z], np.uint64(0))
        odd = (n != n[rep]) | (head != head[rep]) | (tail != tail[rep])
        for i in np.flatnonzero((n > 16) & ~odd & (rep != np.arange(len(n)))).tolist():  # the middle of long words
            odd[i] = self.raw(i) != self.raw(rep[i])
        return np.flatnonzero(odd)

    def raw(self, i: int) -> bytes:
        return self.data[self.a[i] : self.z[i]].tobytes()

    def text(self, i: int) -> str:
        return self.raw(i).decode("utf-8", "surrogatepass").replace(" ", SPACE)


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_POWERS = [powers(BASE, 1 << 16), powers(BASE_INVERSE, 1 << 16)]


def hashes(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """64-bit hash of data[a:z] for spans that lie end to end."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(z, a[at] + (1 << 16) - 1, "right")))
        part = data[a[at] : z[to - 1]]
        while len(_POWERS[0]) <= len(part):  # one word of such a length
            n = 2 * len(_POWERS[0])
            _POWERS[:] = [powers(BASE, n), powers(BASE_INVERSE, n)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * _POWERS[0][: len(part)], out=total[1:])
        x, y = a[at:to] - a[at], z[at:to] - a[at]
        out.append(mix((total[y] - total[x]) * _POWERS[1][x] + (y - x).astype(np.uint64)))
        at = to
    return np.concatenate(out)


def strings(data: np.ndarray, n: np.ndarray) -> pa.Array:
    """Strings of these sizes that lie end to end in UTF-8."""
    offsets = np.append(0, np.cumsum(n)).astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def grouped(text: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """The texts in groups of about GROUP bytes: first row, rows, words. A space is put in front of a text; null and empty ones have no words."""
    t = pc.fill_null(text.cast(pa.string()), "")
    t = pc.replace_substring(t, SPACE, " ")
    t = pc.if_else(pc.equal(pc.binary_length(t), 0), t, pc.binary_join_element_wise(pa.scalar(" "), t, pa.scalar("")))
    t = t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t
    ends = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1].astype(np.int64) if len(t) else np.zeros(1, np.int64)
    data = np.frombuffer(t.buffers()[2], np.uint8) if t.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(t):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + GROUP)))
        to = min(to, len(t))
        yield at, to - at, Words(data[ends[at] : ends[to]], ends[at + 1 : to + 1] - ends[at])
        at = to


def best_paths(words: DataFrame, pieces: DataFrame, bytes_: list[int]) -> DataFrame:
    """ids array<int> for each row of words(word, ...): substrings, join, grouping, fold."""
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 1
    names = words.columns
    at = words.select(*names, F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    size = F.least(F.lit(longest), F.length("word") - F.col("i") + 1)
    sub = at.select(*names, "i", F.explode(F.sequence(F.lit(1), size)).alias("n"))
    sub = sub.select(*names, "i", "n", F.substring("word", F.col("i"), F.col("n")).alias("piece"))
    # the piece table is a vocabulary file: 32,000 rows here, whatever the corpus
    edges = sub.join(F.broadcast(pieces), "piece", "left").where("id is not null or n = 1")
    edge = F.struct((F.col("i") + F.col("n")).cast("int").alias("z"), F.col("i").cast("int").alias("a"), F.coalesce("cost", F.lit(BYTE_COST)).alias("cost"), F.coalesce("id", F.lit(-1)).alias("id"))
    lattice = edges.groupBy(*names).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    # state: for each place reached, least cost and the ids up to it; edges come by end, so places are final when used
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("ids")))

    def step(state: Column, e: Column) -> Column:
        before = F.element_at(state, e["a"])
        new = F.struct((before["cost"] + e["cost"]).alias("cost"), F.concat(before["ids"], F.array(F.when(e["id"] >= 0, e["id"]).otherwise(-e["a"]))).alias("ids"))
        known = F.size(state) >= e["z"]
        return F.when(~known, F.concat(state, F.array(new))).when(new["cost"] < F.element_at(state, -1)["cost"], F.concat(F.slice(state, 1, F.size(state) - 1), F.array(new))).otherwise(state)

    path = F.element_at(F.aggregate("edges", start, step), -1)["ids"]
    table_ = F.array(*[F.lit(x) for x in bytes_])
    # a negative number names the place of a character that goes as bytes
    hexed = lambda i: F.hex(F.encode(F.substring("word", -i, F.lit(1)), "UTF-8"))
    as_bytes = lambda i: F.transform(F.sequence(F.lit(1), (F.length(hexed(i)) / 2).cast("int")), lambda k: F.get(table_, F.conv(F.substring(hexed(i), 2 * k - 1, F.lit(2)), 16, 10).cast("int")))
    return lattice.select(*names, path.alias("path")).select(*names, F.flatten(F.transform("path", lambda i: F.when(i >= 0, F.array(i)).otherwise(as_bytes(i)))).alias("ids"))


def fold(word: str, pieces: dict[str, tuple[int, float]], longest: int, bytes_: list[int]) -> list[int]:
    """The best path of one word of any length, with the ties of best_paths."""
    cost, came = [0.0], [(0, -1)]
    for z in range(1, len(word) + 1):
        least, best = math.inf, (z - 1, -1)
        for a in range(max(0, z - longest), z):
            i, c = pieces.get(word[a:z], (-1, BYTE_COST if a == z - 1 else math.inf))
            if cost[a] + c < least:
                least, best = cost[a] + c, (a, i)
        cost.append(least)
        came.append(best)
    out, z = [], len(word)
    while z:
        a, i = came[z]
        out.append([i] if i >= 0 else [bytes_[b] for b in word[a].encode()])
        z = a
    return [i for part in reversed(out) for i in part]


def long_paths(words: DataFrame, pieces: DataFrame, bytes_: list[int]) -> DataFrame:
    """As best_paths, for words of more than LONG characters."""
    known = {r["piece"]: (r["id"], r["cost"]) for r in pieces.collect()}
    longest = max(map(len, known), default=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(ids=[fold(w, known, longest, bytes_) for w in b["word"]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInPandas(run, f"{schema}, ids array<int>")


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, h (hash), n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for b in batches:
            for _, _, w in grouped(b.column(0)):
                h, at, n = np.unique(w.h, return_index=True, return_counts=True)
                for i, k in ((at, n), (other := w.others(at), np.ones(len(other), np.int64))):
                    size = w.z[i] - w.a[i]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([strings(gather(w.data, w.a[i], size), size), pa.array(w.h[i].view(np.int64)), pa.array(k)], ["word", "h", "n"])

    words = docs.select("text").mapInArrow(count, "word string, h long, n long").groupBy("word", "h").agg(F.sum("n").alias("n"))
    return words.select(F.translate("word", " ", SPACE).alias("word"), "h", "n")


class Dictionary:
    """Ids by a word's hash, as a file mapped into memory: sorted hashes, where each word's ids begin, and the ids."""

    def __init__(self, path: str) -> None:
        n, m, wide = np.fromfile(path, "<i8", 3).tolist()
        self.hashes = np.memmap(path, "<u8", "r", 24, (n,)) if n else np.zeros(0, np.uint64)
        self.start = np.memmap(path, "<u4", "r", 24 + 8 * n, (n + 1,))
        self.ids = np.memmap(path, f"<u{wide}", "r", 24 + 8 * n + 4 * (n + 1), (m,)) if m else np.zeros(0, np.uint16)

    @staticmethod
    def bytes_of(coded: DataFrame, size: int) -> bytes:
        """The file for coded(h, ids) and ids below ``size``."""
        t = coded.select("h", "ids").toArrow()
        lists = [c for c in t["ids"].chunks if len(c)]
        n = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists]) if lists else np.zeros(0, np.int64)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        ids = np.concatenate([c.flatten().to_numpy().astype(kind) for c in lists]) if lists else np.zeros(0, kind)
        h = t["h"].to_numpy().view(np.uint64)
        del t, lists
        order = np.argsort(h)
        before, n = (np.cumsum(n) - n)[order], n[order]
        start = np.append(0, np.cumsum(n)).astype("<u4")
        ids = ids[np.repeat(before - start[:-1], n) + np.arange(n.sum())]
        return np.array([len(h), len(ids), ids.dtype.itemsize], "<i8").tobytes() + h[order].tobytes() + start.tobytes() + ids.tobytes()

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


class Decoder:
    """The piece table as one array of bytes."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = np.array([len(p) for p in pieces])
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(pieces), np.uint8)

    @classmethod
    def of(cls, path: str) -> Decoder:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in ((i, m.id_to_piece(i)) for i in range(m.get_piece_size()))])

    def flat_text(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of texts of n ids each, end to end without the space in front of each, and the size of each."""
        ids = ids.astype(np.int64)
        size = self.size[ids]
        total = np.append(0, np.cumsum(size))
        ends = np.cumsum(n)
        of = total[ends] - total[ends - n]
        data = gather(self.flat, self.start[ids], size)
        keep = np.ones(len(data), bool)
        keep[(np.cumsum(of) - of)[of > 0]] = False
        return data[keep], of - (of > 0)

    def text_of(self, ids) -> str:
        x = np.asarray(ids, np.int64)
        return self.flat_text(x, np.array([len(x)]))[0].tobytes().decode("utf-8", "replace")


def gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start : start + n] of each, one after the other."""
    return flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, text, ids array<int> for every row of docs(doc_id, text); with ``decoded``, also the ids' text.

    Null and empty texts have no ids. The most frequent words, a bounded number, go to every node as a file. If there
    are more, the rest are joined by shuffle, once for each document that holds them, so that no word is hot there; so
    are words of more than LONG characters if there are many. Words are told apart by 64-bit hashes; the few
    whose hashes clash are joined as strings. Repeated rows and very long texts need no care; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or model_path()
    words = stored(vocabulary(docs), "words")
    pieces = piece_table(spark, path)
    table_ = pieces.collect()
    if across := [r["piece"] for r in table_ if len(Words(x := np.frombuffer(r["piece"].replace(SPACE, " ").encode(), np.uint8), np.array([len(x)])).a) > 1]:
        raise ValueError(f"pieces reach across words: {across[:5]}")
    is_long = F.length("word") > LONG
    total, characters = words.agg(F.count("*"), F.coalesce(F.sum(F.when(is_long, F.length("word"))), F.lit(0))).first()
    clash = np.array(sorted(r["h"] for r in words.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").collect()), np.int64).view(np.uint64)
    dealt = words.repartition(max(shuffle_partitions(spark), total // WORDS_A_TASK + 1), "word").select("word", "h")
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, 4 * WORDS_A_TASK)  # a task's lattices fit its memory; sorting them would only spill
    try:
        bytes_ = byte_ids(path)
        long_ones = words.where(is_long).select("word", "h").repartition(int(characters) // 100_000 + 1)
        coded = stored(best_paths(dealt.where(~is_long), pieces, bytes_).union(long_paths(long_ones, pieces, bytes_)), "coded")
    finally:
        spark.conf.set(key, old)
    all_known = total <= FREQUENT and characters <= LONG_CHARACTERS and not len(clash)
    top = coded if all_known else words.where(~is_long).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").join(coded, "word")
    decoder = Decoder.of(path)
    data = Dictionary.bytes_of(top, len(decoder.size))
    name = f"words-{xxhash.xxh64_hexdigest(data)}.bin"
    ship(spark, data, f"{shared_dir(spark)}/{name}")
    del data
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    if not all_known:  # they are joined by number, which has to stay as it is
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        d = Dictionary(SparkFiles.get(name))
        for b in batches:
            row = b.column(0).to_numpy()
            for at, n, w in grouped(b.column(1)):
                ok = d.find(w.h)[1] & ~np.isin(w.h, clash)
                out = []
                for i, (x, y) in enumerate(zip(w.first.tolist(), w.last.tolist())):
                    out += [(int(row[at + i]), t) for t in {w.text(x + j) for j in np.flatnonzero(~ok[x:y]).tolist()}]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([t for _, t in out], pa.string())], ["row", "word"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        d = Dictionary(SparkFiles.get(name))
        for b in batches:
            for at, rows_, w in grouped(b.column(1)):
                h, inverse = np.unique(w.h, return_inverse=True)
                place, ok = d.find(h)
                ok &= ~np.isin(h, clash)
                start, n = d.start[place].astype(np.int64), d.start[place + 1].astype(np.int64) - d.start[place]
                start, n = start[inverse], n[inverse]
                if ok.all():
                    ids = gather(d.ids, start, n)
                else:
                    own = {}
                    for rare_ in b.column(2).slice(at, rows_).to_pylist():
                        own |= {r["word"]: r["ids"] for r in rare_ or ()}
                    odd = np.flatnonzero(~ok[inverse])
                    found = [own[w.text(j)] for j in odd.tolist()]
                    base, k = len(d.ids), np.array([len(x) for x in found])
                    start[odd], n[odd] = base + np.cumsum(k) - k, k
                    ids = gather(np.concatenate([d.ids, *[np.array(x, np.uint32) for x in found]]), start, n)
                before = np.append(0, np.cumsum(n))
                of = before[w.last] - before[w.first]
                ids_ = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(of)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                part = [b.column(0).slice(at, rows_), b.column(1).slice(at, rows_), ids_] + ([strings(*decoder.flat_text(ids, of))] if decoded else [])
                yield pa.RecordBatch.from_arrays(part, ["doc_id", "text", "ids"] + ["decoded"] * decoded)

    if all_known:
        full = rows.select("doc_id", "text", F.lit(None).cast("array<struct<word:string,ids:array<int>>>").alias("rare"))
    else:
        found = rows.select("row", "text").mapInArrow(rare, "row long, word string").join(coded, "word").groupBy("row").agg(F.collect_list(F.struct("word", "ids")).alias("rare"))
        full = rows.join(found, "row", "left").select("doc_id", "text", "rare")
    return full.mapInArrow(put, f"doc_id {kind}, text string, ids array<int>" + ", decoded string" * decoded)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """coded with ``decoded``: the text of ids array<int>; null for null.

    A task holds the piece table, whose size is the vocabulary's, and looks each id up in it.
    """
    decoder = Decoder.of(path or model_path())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            yield b.assign(decoded=[None if x is None else decoder.text_of(x) for x in b["ids"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInPandas(run, f"{schema}, decoded string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, a hash of the ids, and whether decoding gives the text again."""
    coded = encode(table(spark, sf_dir, "documents"), decoded=True)
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), same.alias("round_trip"))
