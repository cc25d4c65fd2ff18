"""URL filters by a sorted array of digests.

Every rule is the string host + path. Its 64-bit xxhash goes into one sorted array, which is written with the
strings to the shared folder, shipped to every executor with ``addFile`` and memory-mapped there. A batch of
urls makes its candidate keys (suffixes of the host at label borders, times the path cut to each length that
a rule's path has), hashes them, and probes the array with one vectorised binary search; the stored string
of a hit is compared, so that equal digests of different strings do no harm. The longest rule that fits wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .common import ship, table

#: (verdict, host, path) as the query fixes them.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

HEADER = np.dtype([("digest", "<u8"), ("at", "<i8"), ("size", "<i4"), ("allow", "i1"), ("host", "<i4")])


def build_index(rules: Iterable[tuple[str, str, str]]) -> tuple[bytes, list[int], list[int]]:
    """The file's bytes (sorted records, then the strings), the lengths of the rules' paths and the labels of their hosts.

    Repeated rules keep the last verdict. Host letters A-Z are lower-cased.
    """
    last = {}
    for verdict, host, path in rules:
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        last[(host, path)] = verdict
    strings = [((h + p).encode(), len(h.encode()), v) for (h, p), v in last.items()]
    records = np.zeros(len(strings), HEADER)
    at = 0
    for i, (s, h, v) in enumerate(strings):
        records[i] = (xxhash.xxh64_intdigest(s), at, len(s), v == "allow", h)
        at += len(s)
    order = np.argsort(records["digest"], kind="stable")
    lengths = sorted({len(p) for _, p in last})
    return np.int64(len(records)).tobytes() + records[order].tobytes() + b"".join(s for s, _, _ in strings), lengths, sorted({h.count(".") + 1 for h, _ in last})


class DigestIndex:
    """Memory-mapped view of a file made by build_index."""

    def __init__(self, path: str) -> None:
        n = int(np.fromfile(path, "<i8", 1)[0])
        self.records = np.memmap(path, HEADER, "r", 8, (n,)) if n else np.zeros(0, HEADER)
        self.text = np.memmap(path, np.uint8, "r", 8 + n * HEADER.itemsize) if n else b""
        self.digests = self.records["digest"]

    def probe(self, keys: list[bytes], host_sizes: np.ndarray) -> np.ndarray:
        """Record number for each key, -1 where it is no rule."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return found
        d = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        left = np.searchsorted(self.digests, d)
        hit = np.flatnonzero(self.digests[np.minimum(left, len(self.digests) - 1)] == d)
        for i in hit:
            j = int(left[i])
            while j < len(self.digests) and self.digests[j] == d[i]:  # equal digests stand side by side
                r = self.records[j]
                if r["host"] == host_sizes[i] and bytes(self.text[r["at"] : r["at"] + r["size"]]) == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found


def split_url(column) -> tuple:
    """Host (A-Z lower-cased) and path of a url as columns; null and urls without :// give empty strings."""
    url = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    Null urls and urls without ``://`` have an empty host and path; with no rule that fits, rule is null and
    the verdict is ``default``. Hosts and paths may be of any length and number of labels. Repeated rows are judged one by one; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    data, lengths, labels = build_index(rules)
    name = f"rules-{xxhash.xxh64_hexdigest(data)}.bin"
    where = f"{shared_dir(spark)}/{name}"
    ship(spark, data, where)
    host, path = split_url("url")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = DigestIndex(SparkFiles.get(name))
        for b in batches:
            keys, rows, hosts = [], [], []
            for i, (h, p) in enumerate(zip(b["host"], b["path"])):
                if not h:
                    continue
                parts = h.rsplit(".", labels[-1]) if labels else []
                have = len(parts) - (len(parts) > labels[-1]) if labels else 0  # labels told apart
                for k in labels:
                    if k > have:
                        break
                    tail = ".".join(parts[len(parts) - k :])
                    for n in lengths:
                        if n <= len(p):
                            keys.append((tail + p[:n]).encode())
                            rows.append(i)
                            hosts.append(len(tail.encode()))
            found = index.probe(keys, np.array(hosts))
            rule, verdict, most = [None] * len(b), [default] * len(b), [(-1, -1)] * len(b)
            for i, k, f in zip(rows, keys, found):
                if f >= 0:
                    r = index.records[f]
                    if (int(r["size"]), int(r["host"])) > most[i]:
                        most[i] = (int(r["size"]), int(r["host"]))
                        rule[i], verdict[i] = k.decode(), "allow" if r["allow"] else "block"
            yield b.assign(rule=pd.Series(rule, dtype=object, index=b.index), verdict=verdict)

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInPandas(judge, schema)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

OP10_SQL = f"""
with parts as (
  select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) as path from parts
), rules(verdict, h, p) as (values {_RULES_SQL}),
fit as (
  select page_id, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as verdict
  from split join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') as verdict from split s left join fit f using (page_id)
"""
