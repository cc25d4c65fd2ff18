"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy

# The four base patterns of the contract, the two added ones, and their context words.
BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn"]
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.ASCII),
    "ssn": re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "ssn": 0.4}
CONTEXT = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "credit", "payment"},
    "phone": {"phone", "call", "tel", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer", "konto"},
    "ssn": {"ssn", "social", "security", "insurance"},
}
AGAINST = {"version", "release", "build", "isbn", "order", "invoice"}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: The ip pattern begins with a whole run of digits in any case; saying so keeps a long run from being tried at each digit.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def confirmed(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind in ("card", "phone"):
        digits = re.sub("[^0-9]", "", s)
        return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
    if kind == "iban":
        return mod97(s)
    if kind == "ssn":
        a, b, c = s.split("-")
        return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    return True


def matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: addresses are looked for around each @."""
    if kind != "email":
        for m in (IP if kind == "ip" else PATTERNS[kind]).finditer(text):
            yield m.span()
        return
    done, at = 0, text.find("@")
    while at >= 0:
        size = LOCAL.match(text[done:at][::-1]).end()  # what stands before the @, back to the last @ or match
        domain = DOMAIN.match(text, at + 1) if size else None
        if domain:
            yield at - size, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def score(kind: str, text: str, start: int, end: int, window: int = 40) -> float:
    """Prior of the kind, raised by its own context words nearby and lowered by words that speak against it."""
    near = {w.lower() for w in WORD.findall(text[max(0, start - window) : start] + " " + text[end : end + window])}
    s = PRIOR[kind] + 0.2 * bool(near & CONTEXT[kind]) - 0.3 * bool(near & AGAINST)
    return min(1.0, max(0.0, s))


def find_spans(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive.

    Base spans stay whatever their score; added ones need ``threshold``.
    """
    out: list[tuple[str, int, int, float]] = []
    if not text:
        return out
    for kind in BASE + ADDED:
        for a, z in matches(kind, text):
            if confirmed(kind, text[a:z]):
                s = score(kind, text, a, z)
                if kind in BASE or s >= threshold:
                    out.append((kind, a, z, s))
    return out


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with every span replaced by <KIND>; overlapping spans become one, named by the first."""
    if not spans:
        return text
    parts, at, end = [], 0, -1
    for kind, a, z, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            parts += [text[at:a], f"<{kind.upper()}>"]
        end = at = max(end, z)
    return "".join([*parts, text[at:]])


def pii_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans array<struct<kind,start,end,score>> of every whole text; null and empty texts have none.

    Rows are handled one by one in Arrow batches: ties, repeated rows, clashing columns and empty tables need
    no care. Work is linear in the text, also for very long runs of digits or letters. An added kind is left out where its score stays
    below ``threshold``: an ``ssn`` without a word for it nearby, either kind beside a word that speaks against it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            spans = [[{"kind": k, "start": a, "end": z, "score": s} for k, a, z, s in find_spans(t, threshold)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": spans})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redacted(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with the spans of every text replaced; columns as they are. Null texts stay null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            new = [redact(t, find_spans(t, threshold)) for t in b.iloc[:, at]]
            b.isetitem(at, pd.Series(new, dtype=object, index=b.index))
            yield b

    return docs.mapInPandas(run, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns from the spans, and the score of each; Spark's own functions do the rest."""
    from pyspark.sql import functions as F

    docs = pii_spans(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return docs.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), scores.alias("scores"))


def base_digest(text: str | None) -> str:
    """Brute-force version for tests: each pattern over the whole text."""
    spans = [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in PATTERNS[k].finditer(text or "") if confirmed(k, m[0])]
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
