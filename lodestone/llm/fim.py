"""Fill-in-the-middle by displacement scatter.

The texts of a batch lie in one buffer of bytes. Cuts are found by a scan for line ends; from them every byte's shift
between the text and its output follows as a sum over a difference array, which holds a value only where a segment begins. A
scatter along the shifts writes all outputs of the batch at once; the inverse parses the outputs' marks, sums shifts the same way
and gathers the texts back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
SEED = 7
RATE, SPM = 100, 50  # per cent of the documents that are cut at all; of those, with the suffix first
WINDOW = 1 << 20  # bytes moved at once: bounds the arrays of shifts, whatever a text's length
SLICE = 1 << 23  # bytes of texts that are worked on together, a longer text alone
#: Order of the segments prefix (0), middle (1) and suffix (2) in an output.
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks have to be found again: none may hold another or begin as one of them ends."""
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"marks {a} and {b} overlap")


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """h1 to h4; a null id counts as the empty text."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def shifted(source: np.ndarray, size: int, starts: np.ndarray, shifts: np.ndarray, gather: bool) -> np.ndarray:
    """size bytes, made by moving bytes along shifts.

    starts: ascending, where a new shift begins (in source for a scatter, in the result for a gather); repeated starts leave
    the last one's shift. A negative start of the first segment isn't allowed.
    """
    out = np.zeros(size, np.uint8)
    length = size if gather else len(source)
    delta = np.diff(shifts, prepend=0)
    carry, k = 0, 0
    for at in range(0, length, WINDOW):
        n = min(WINDOW, length - at)
        z = k + int(np.searchsorted(starts[k:], at + n))
        d = np.zeros(n, np.int64)
        np.add.at(d, starts[k:z] - at, delta[k:z])
        move = np.cumsum(d) + carry
        carry, k = int(move[-1]), z
        here = np.arange(at, at + n)
        if gather:
            out[at : at + n] = source[here + move]
        else:
            out[here + move] = source[at : at + n]
    return out


def units(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text data[a:z]: its number of lines; and all line ends with the place of each text's first among them."""
    ends = np.flatnonzero(data == 10) + 1
    first = np.searchsorted(ends, a, side="right")
    n = np.searchsorted(ends, z, side="right") - first
    full = z > a
    open_ = full & (data[np.maximum(z - 1, 0)] != 10) if len(data) else full
    return n + open_, ends, first


def scatter(data: np.ndarray, at: np.ndarray, cuts: np.ndarray, forms: list[str], marks: tuple[str, str, str] = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """The outputs' bytes and offsets. at: offsets of n texts in data (n + 1); cuts: n x 2, where middle and suffix begin."""
    raw = [np.frombuffer(m.encode(), np.uint8) for m in (marks[0], marks[2], marks[1])]  # by segment
    edges = np.column_stack([at[:-1], cuts, at[1:]])
    size = np.diff(edges, axis=1)
    cut = np.array([f != "plain" for f in forms], bool)
    to = np.zeros(len(at), np.int64)
    np.cumsum(at[1:] - at[:-1] + cut * sum(map(len, raw)), out=to[1:])
    shift = np.repeat((to[:-1] - at[:-1])[:, None], 3, axis=1)  # as for plain
    marked = []
    for form, order in ORDER.items():
        rows = np.array([f == form for f in forms], bool)
        place = to[:-1][rows]
        for s in order:
            marked.append((place, raw[s]))
            place = place + len(raw[s])
            shift[rows, s] = place - edges[rows, s]
            place = place + size[rows, s]
    out = shifted(data, int(to[-1]), edges[:, :3].ravel(), shift.ravel(), gather=False)
    for place, mark in marked:
        out[place[:, None] + np.arange(len(mark))] = mark
    return out, to


def gather(out: np.ndarray, to: np.ndarray, forms: list[str], marks: tuple[str, str, str] = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and offsets, from outputs and forms alone."""
    raw, buffer = [m.encode() for m in (marks[0], marks[2], marks[1])], out.tobytes()
    begin = np.zeros((len(forms), 3), np.int64)  # of each segment's bytes in the output
    size = np.zeros((len(forms), 3), np.int64)
    for i, form in enumerate(forms):
        a, z = int(to[i]), int(to[i + 1])
        if form == "plain":
            begin[i], size[i] = a, (z - a, 0, 0)
            continue
        order, place = ORDER[form], a
        for k, s in enumerate(order):
            place += len(raw[s])
            end = buffer.index(raw[order[k + 1]], place, z) if k < 2 else z
            begin[i, s], size[i, s] = place, end - place
            place = end
    at = np.zeros(len(to), np.int64)
    np.cumsum(size.sum(axis=1), out=at[1:])
    starts = at[:-1, None] + np.cumsum(size, axis=1) - size
    return shifted(out, int(at[-1]), starts.ravel(), (begin - starts).ravel(), gather=True), at


def transformed(batch: pa.Array, ids: list, seed: int, rate: int, spm: int, marks: tuple[str, str, str]) -> dict:
    """Everything about a slice of texts, as arrays and lists in the rows' order."""
    offsets = np.frombuffer(batch.buffers()[1], np.int64)[batch.offset : batch.offset + len(batch) + 1]
    data = np.frombuffer(batch.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    whole, raw = data.tobytes(), [m.encode() for m in marks]
    n, ends, first = units(data, at[:-1], at[1:])
    forms, cuts = [], np.empty((len(ids), 2), np.int64)
    for i, doc in enumerate(ids):
        a, z = int(at[i]), int(at[i + 1])
        h = draws(doc, seed)
        held = a == z or any(whole.find(m, a, z) >= 0 for m in raw)
        forms.append("plain" if held or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm")
        for k, c in enumerate(sorted((h[0] % (int(n[i]) + 1), h[1] % (int(n[i]) + 1)))):
            cuts[i, k] = a if c == 0 else z if c == n[i] else ends[first[i] + c - 1]
    chars = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    out, to = scatter(data, at, cuts, forms, marks)
    return {"n": n, "forms": forms, "cuts": cuts, "prefix": chars[cuts[:, 0]] - chars[at[:-1]], "middle": chars[cuts[:, 1]] - chars[cuts[:, 0]], "out": out, "to": to}


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows whose texts have SLICE bytes at most (or a single row), with the texts as binaries."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        yield batch.slice(a, z - a), texts.slice(a, z - a)
        a = z


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS, digests: bool = False) -> DataFrame:
    """One row for each of docs: doc_id, n, form, prefix_chars, middle_chars and output; with ``digests``, output_sha256 and restored_sha256 in its place.

    A text is cut at line borders, both drawn from its doc_id, so equal ids with equal texts get equal outputs. A null text is empty; an empty
    text, or one that holds a mark, stays as it is (``plain``; lengths null). A null id is drawn like the empty text. Repeated rows
    each give a row; an empty table gives none; other columns are ignored. Nothing is shuffled, and a batch's arrays are bounded
    by SLICE, or by the longest text.
    """
    check_marks(marks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "output_sha256 string, restored_sha256 string" if digests else "output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b):
                r = transformed(texts, part.column("doc_id").to_pylist(), seed, rate, spm, marks)
                plain = np.array([f == "plain" for f in r["forms"]], bool)
                long = lambda x: pa.array(np.asarray(x, np.int64), mask=plain)
                columns = [part.column("doc_id"), pa.array(np.asarray(r["n"], np.int64)), pa.array(r["forms"], pa.string()), long(r["prefix"]), long(r["middle"])]
                if digests:
                    back, at = gather(r["out"], r["to"], r["forms"], marks)
                    for data, to in ((r["out"], r["to"]), (back, at)):
                        view = memoryview(data)
                        columns.append(pa.array([hashlib.sha256(view[to[i] : to[i + 1]]).hexdigest() for i in range(len(texts))], pa.string()))
                else:
                    columns.append(strings(r["out"], r["to"]).cast(b.schema.field("text").type))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in f"doc_id {kind}, n, form, prefix_chars, middle_chars, {last}".split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, {last}")


def restore(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, text: the texts rebuilt from ``output`` and ``form``. Null texts come back empty."""
    kind = made.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, outputs in slices(b, "output"):
                offsets = np.frombuffer(outputs.buffers()[1], np.int64)[outputs.offset : outputs.offset + len(outputs) + 1]
                data = np.frombuffer(outputs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                back, at = gather(data, offsets - offsets[0], part.column("form").to_pylist(), marks)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), strings(back, at).cast(b.schema.field("output").type)], ["doc_id", "text"])

    return made.select("doc_id", "form", "output").mapInArrow(run, f"doc_id {kind}, text string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), digests=True)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
     l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines FROM d),
     u AS (SELECT *, len(lines)::BIGINT AS n,
                  ('0x' || substr(h, 1, 8))::BIGINT % (len(lines) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(lines) + 1) AS c2,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
                       WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
           FROM l),
     c AS (SELECT *, array_to_string(lines[1 : least(c1, c2)], '') AS prefix, array_to_string(lines[least(c1, c2) + 1 : greatest(c1, c2)], '') AS middle,
                  array_to_string(lines[greatest(c1, c2) + 1 :], '') AS suffix FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
