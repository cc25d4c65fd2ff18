"""Markdown and plain text to chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup
from ..functions.scalars import strip

SIZE, OVERLAP, HEADER_ONLY = 500, 50, 40
#: Layers that metadata may name; a corpus gives its own.
LAYERS = ["strategy", "product", "engineering", "operations", "research", "personal"]
FIELDS = "type string, title string, description string, doc_id string, id string, layer array<string>, project string, status string, keywords array<string>, related array<string>"


def parse_documents(files: DataFrame) -> DataFrame:
    """files(path, content) with meta struct, body and parse_error: a YAML block between --- lines is the metadata.

    Without a block the metadata is empty; a malformed one gives an error instead of metadata. Bare strings
    become lists of one where a list is due.
    """
    names = [f.name for f in T._parse_datatype_string(FIELDS).fields]
    lists = {"layer", "keywords", "related"}

    def one(text: str) -> tuple[dict, str, str | None]:
        import yaml

        lines = (text or "").split("\n")
        if lines[0].strip() != "---" or "---" not in [x.strip() for x in lines[1:]]:
            return {}, text or "", None
        end = 1 + [x.strip() for x in lines[1:]].index("---")
        try:
            raw = yaml.safe_load("\n".join(lines[1:end])) or {}
            if not isinstance(raw, dict):
                raise yaml.YAMLError("metadata is no mapping")
        except yaml.YAMLError as e:
            return {}, text, type(e).__name__
        return raw, "\n".join(lines[end + 1 :]).lstrip("\n"), None

    def value(raw: dict, name: str):
        v = raw.get(name)
        if v is None:
            return None
        if name in lists:
            return [str(x) for x in (v if isinstance(v, list) else [v])]
        return str(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [one(t) for t in b["content"]]
            yield pd.DataFrame({"path": b["path"], "meta": [{n: value(m, n) for n in names} for m, _, _ in out], "body": [x[1] for x in out], "parse_error": [x[2] for x in out]})

    return files.select("path", "content").mapInPandas(run, f"path string, meta struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>, body string, parse_error string")


def normalised(parsed: DataFrame, layers: list[str] = LAYERS) -> DataFrame:
    """Metadata columns with defaults: doc_id from the file's stem, lower case, empty lists as null, unknown layers named."""
    m = lambda n: F.col(f"meta.{n}")
    low = lambda c: F.nullif(F.lower(strip(c)), F.lit(""))
    some = lambda a: F.when(F.size(a) > 0, a)
    layer = F.transform(m("layer"), lambda x: F.lower(strip(x)))
    return parsed.select(
        "path",
        F.coalesce(m("doc_id"), m("id"), F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)).alias("doc_id"),
        m("title").alias("title"),
        layer.alias("layer"),
        low(m("project")).alias("project"),
        low(m("status")).alias("status"),
        some(m("keywords")).alias("keywords"),
        some(m("related")).alias("related"),
        F.array_except(F.coalesce(layer, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in layers])).alias("unknown_layers"),
        "body",
        "parse_error",
    )


def context_prefix(fields: dict[str, Column]) -> Column:
    """'Name: value' lines in the given order, empty ones left out, and two line ends; '' without any."""
    lines = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()]))
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")


def split_at(text: Column, header: str) -> tuple[Column, Column]:
    """The headers that match, and the texts before, between and behind them: one more."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(t, F.lit(header), 0), F.split(t, header, -1)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "body") -> DataFrame:
    """(key, no, section, content): what precedes the first header of level 2 or 3, unless blank, and a part for each header.

    A part is its header, a line end and the stripped body, or the header alone. Without headers the whole text is the one
    part, also if it is empty.
    """
    heads, bodies = split_at(F.col(text), r"(?dm)^#{2,3}\s+.+$")
    first = strip(F.get(bodies, F.lit(0)))
    part = lambda h, b: F.struct(h.alias("section"), F.concat_ws("\n", h, F.nullif(strip(b), F.lit(""))).alias("content"))
    lead = F.when((first != "") | (F.size(heads) == 0), F.array(F.struct(F.lit("").alias("section"), first.alias("content"))))
    parts = F.concat(F.coalesce(lead, F.array().cast("array<struct<section:string,content:string>>")), F.zip_with(heads, F.slice(bodies, 2, F.size(heads)), part))  # a text is split once, not for each header
    return docs.select(key, F.posexplode(parts).alias("no", "part")).select(key, "no", "part.section", "part.content")


def header_only(content: Column, section: Column) -> Column:
    return F.length(strip(F.substring(content, F.length(section) + 1, F.length(content)))) < HEADER_ONLY


def words(text: Column) -> Column:
    """Default tokenizer: words, each with the white space after it; the first also with that before."""
    return F.regexp_extract_all(text, F.lit(r"(?:\A\s+)?\S+\s*"), 0)


def windows(rows: DataFrame, text: str, keep: list[str], size: int = SIZE, overlap: int = OVERLAP, tokenize: Callable[[Column], Column] = words, short_whole: bool = True) -> DataFrame:
    """(keep, window, content): texts beyond ``size`` tokens in windows that overlap, others whole.

    With ``short_whole`` off every text goes in windows, so what the first one shares with the next may stand alone.
    """
    x = rows.withColumn("__t", tokenize(F.col(text)))
    n = F.size("__t")
    starts = F.when(n > (size if short_whole else size - overlap), F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array(F.lit(0)))
    # cut within the row: a long text's tokens don't go with each of its windows
    cut = F.transform(starts, lambda s: F.when((F.size("__t") <= size) & (s == 0), F.col(text)).otherwise(F.array_join(F.slice("__t", s + 1, size), "")))
    return x.select(*keep, F.posexplode(cut).alias("window", "content"))


def content_chunks(docs: DataFrame, key: str = "doc_id", text: str = "body", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, position, section_title, is_section_title, content): each header of level 1 to 3 is a chunk, then its body's windows, as it stands."""
    header = r"(?dm)^#{1,3}\s+(.*)$"
    heads, bodies = split_at(F.col(text), header)
    titles = F.concat(F.array(F.lit(None).cast("string")), F.transform(heads, lambda h: strip(F.regexp_extract(h, header, 1))))
    rows = docs.select(key, F.posexplode(F.arrays_zip(titles.alias("title"), bodies.alias("body"))).alias("no", "part")).select(key, "no", "part.title", "part.body")
    w = windows(rows.where(strip(F.col("body")) != "").select(key, "no", "title", "body"), "body", [key, "no", "title"], size, overlap, short_whole=False)
    heads = rows.where("title is not null").select(key, "no", "title", F.lit(-1).alias("window"), F.col("title").alias("content"))
    position = F.row_number().over(Window.partitionBy(key).orderBy("no", "window")) - 1
    return heads.union(w.select(key, "no", "title", "window", "content")).select(key, position.alias("position"), F.col("title").alias("section_title"), (F.col("window") < 0).alias("is_section_title"), "content")


def hashed_words(width: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: signed word counts in hashed places."""
    from hashlib import md5

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in (t or "").lower().split():
                h = int(md5(w.encode()).hexdigest()[:8], 16)
                v[h % width] += 1.0 if h >> 31 else -1.0
            out.append(v)
        return out

    return embed


def embedded(rows: DataFrame, text: str, embed_batch: Callable[[list[str]], list[list[float]]], width: int, stamp: str) -> DataFrame:
    """rows with embedding and embedding_model; a batch whose count or width is wrong fails the job."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedding_model", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = embed_batch(b[text].tolist())
            if len(v) != len(b) or any(len(x) != width for x in v):
                raise ValueError("the embedder returned vectors of another count or width")
            yield b.assign(embedding=v, embedding_model=stamp)

    return rows.mapInPandas(run, schema)


def log_entries(docs: DataFrame, key: str = "doc_id", text: str = "body") -> DataFrame:
    """(key, entry, date, title, body) of dated logs.

    '## [run: D]' and '## D' set the date, '## D (title)' is an entry of its own, and so is a header of level 2 of any other
    shape, which takes the first date in it if it has one. '### title' is an entry of the date before it unless it has its
    own. Entries without a date are left out, a rule at the end of a body is cut.
    """
    # The forms of a date and of headers that hold one.
    date = r"\d{4}-\d{2}-\d{2}"
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)).alias("line", "t"))
    level2, level3 = F.startswith("t", F.lit("## ")), F.startswith("t", F.lit("### "))
    lines = lines.select(key, "line", "t", F.when(level2, 2).when(level3, 3).alias("level"), F.when(level2, strip(F.substring("t", 4, 1 << 30))).when(level3, strip(F.substring("t", 5, 1 << 30))).alias("h"))
    some = lambda pattern, group: F.nullif(F.regexp_extract("h", pattern, group), F.lit(""))
    titled = rf"^({date})\s*\((.+)\)$"
    groups = F.coalesce(some(rf"^\[(?:run:\s*)?({date})\]$", 1), some(rf"^({date})$", 1))
    two = F.col("level") == 2
    w = Window.partitionBy(key).orderBy("line")
    x = lines.withColumns({"own": some(titled, 1), "head": F.col("level").isNotNull() & ~(two & groups.isNotNull())})
    x = x.withColumns({"current": F.last(F.when(two, F.coalesce("own", groups, some(f"({date})", 1))), True).over(w), "entry": F.count("level").over(w)})
    heads = x.where("head").select(key, "entry", F.coalesce("own", "current").alias("date"), F.coalesce(some(titled, 2), "h").alias("title")).where("date is not null")
    bodies = x.where("level is null").groupBy(key, "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n").alias("body"))
    body = strip(F.regexp_replace(F.coalesce("body", F.lit("")), r"\n?-{3,}\s*$", ""))
    return heads.join(bodies, [key, "entry"], "left").select(key, "entry", "date", "title", body.alias("body"))


def article_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with article and fetch_status (ok, fallback_used or failed); see `functions.markup`."""

    # rows go to Python by the hundred, however large pages are; Arrow's batches have ten thousand
    @F.udf(returnType="article string, fetch_status string", useArrow=False)
    def read(html_: str) -> tuple[str, str]:
        return markup.article(html_)

    return pages.withColumn("__read", read(F.col(html))).withColumns({"article": F.col("__read.article"), "fetch_status": F.col("__read.fetch_status")}).drop("__read")


def plain_text(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with text, rejected with reason) of uploads(mime, base64 data)."""
    ok = F.col("mime").isin("text/plain", "text/markdown")
    text = F.decode(F.unbase64("data"), "UTF-8")
    return uploads.where(ok).withColumn("text", text), uploads.where(~F.coalesce(ok, F.lit(False))).withColumn("reason", F.concat(F.lit("unsupported type "), F.coalesce("mime", F.lit("none"))))
