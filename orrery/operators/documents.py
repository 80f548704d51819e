"""Documents: languages, sentences, chunks, clauses, entities."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions import tokens

CHUNKS = "chunk_index int, text string, n_words int, n_sentences int, page_start int, page_end int"


#: Rows and bytes of a batch that a task turns into Python objects at a time; a row that is longer comes alone.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 22


def slices(batch):
    """A batch in parts of few rows and bytes, so that what a task holds does not grow with its partition."""
    start, size = 0, max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    while start < batch.num_rows:
        yield batch.slice(start, size)
        start += size


def page_sentences(pages: DataFrame, key: str = "doc_sha256") -> DataFrame:
    """(key, page, n, sentence): the sentences of each page in order."""
    return pages.select(key, "page", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


def sentence_spans(pages: DataFrame, key: str = "doc_sha256") -> DataFrame:
    """(key, page, n, span_start, span_end, sentence): sentences with their places in the stripped text of the page, in code points."""

    kinds = dict(pages.dtypes)
    ddl = f"{key} {kinds[key]}, page {kinds['page']}, n int, span_start int, span_end int, sentence string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                found = [tokens.sentence_spans(t or "") for t in part.column(2).to_pylist()]
                row = pa.array([k for k, spans in enumerate(found) for _ in spans], pa.int32())
                own = [part.column(k).take(row) for k in (0, 1)]
                n = pa.array([n for spans in found for n in range(len(spans))], pa.int32())
                starts, ends, texts = (pa.array([x[c] for spans in found for x in spans], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.string())))
                yield pa.RecordBatch.from_arrays([*own, n, starts, ends, texts], names=[key, "page", "n", "span_start", "span_end", "sentence"])

    return pages.select(key, "page", "text").mapInArrow(run, ddl)


def chunk(pages: DataFrame, least: int = 400, most: int = 800, key: str = "doc_sha256", more: tuple[str, ...] = ("lang",), parts: Column | None = None) -> DataFrame:
    """Pages of a document packed into chunks of whole sentences.

    Before a sentence is added the chunk ends if it has at least `least` words and would
    get more than 1.2 x most; after that it ends if it has at least `most`; the rest is a
    chunk. parts: a page's sentences, those of its text if none are given. Pages are dealt by
    document and sorted, then go on sentence by sentence and are packed as they stream by:
    a task holds a batch of sentences and those of one open chunk, however long the document is.
    """
    dealt = pages.select(key, *more, "page", (T.sentences(F.col("text")) if parts is None else parts).alias("parts")).repartition(key).sortWithinPartitions(key, "page")
    rows = dealt.select(key, *more, "page", F.explode("parts").alias("sentence"))
    kinds = dict(rows.dtypes)
    limit = int(1.2 * most)

    def pack(batches):
        import pandas as pd

        doc = rest = None
        index, held, words = 0, [], 0
        out: list[tuple] = []

        def flush():
            nonlocal index, held, words
            if held:
                index += 1
                out.append((doc, *rest, index, " ".join(s for s, _ in held), words, len(held), held[0][1], held[-1][1]))
            held, words = [], 0

        for pdf in batches:
            for k, *extra, page, s in pdf.itertuples(index=False, name=None):
                if k != doc:
                    flush()
                    doc, rest, index = k, extra, 0
                n = len(s.split())
                if not n:
                    continue
                if words >= least and words + n > limit and words + n > most:
                    flush()
                held.append((s, page))
                words += n
                if words >= least and words >= most:
                    flush()
            yield pd.DataFrame(out, columns=names)
            out.clear()
        flush()
        yield pd.DataFrame(out, columns=names)

    names = [key, *more, *(c.split()[0] for c in CHUNKS.split(", "))]
    head = ", ".join(f"{c} {kinds[c]}" for c in (key, *more))
    return rows.mapInPandas(pack, f"{head}, {CHUNKS}")


def chunk_metrics(chunks: DataFrame) -> DataFrame:
    q = F.percentile("n_words", F.array(F.lit(0.5), F.lit(0.95)))
    return chunks.agg(F.count("*").alias("chunks"), F.round(F.avg("n_words"), 6).alias("mean"), q[0].alias("median"), q[1].alias("p95"), F.min("n_words").alias("least"), F.max("n_words").alias("most"))


def load_metrics(pages: DataFrame) -> DataFrame:
    """Rows, words and empty pages by source and language."""
    return pages.groupBy("source", "lang").agg(F.count("*").alias("pages"), F.sum(T.word_count(F.col("text"))).alias("words"), F.count_if(T.word_count(F.col("text")) == 0).alias("empty_pages"))


def majority_lang(pages: DataFrame, key: str) -> DataFrame:
    """The most frequent language of each key, the smallest of several."""
    return pages.groupBy(key).agg(F.mode("lang", True).alias("lang"), F.sum(T.word_count(F.col("text"))).alias("words"))


def clauses(pages: DataFrame, patterns: dict[str, str] = T.CLAUSE_PATTERNS, langs: tuple[str, ...] = ("en", "ar")) -> DataFrame:
    """A row per sentence and clause class that it has, in pages of these languages."""
    rows = pages.filter(F.col("lang").isin(*langs)).select("doc_sha256", "page", "lang", F.posexplode(T.sentences(F.col("text"))).alias("n", "text"))
    return rows.select("doc_sha256", "page", "lang", "n", "text", F.explode(T.clause_classes(F.col("text"), patterns)).alias("clause_type"))


# Patterns of the Arabic entities.
ARABIC_ENTITIES = {
    "DATE": r"(20\d{2}|19\d{2})",
    "PERCENT": r"\d+\s*%",
    "QUANTITY": r"(?i)\b(\d+(?:[\.,]\d+)?\s*(?:tco2e|co2|co₂|kwh|mwh|gwh|tonnes?|m3|m³))\b",
}
# The words and units of the English fallback; a title is a capital with lower-case letters.
COMPANY_FORMS = ("llc", "plc", "pjsc", "inc.", "inc")
PLACES = ("UAE", "Dubai", "Abu Dhabi", "KSA", "Saudi", "Qatar", "Bahrain", "Oman", "Kuwait")
_TITLE = r"[A-Z][a-z]*"
ENGLISH_ENTITIES = {
    "ORG": rf"\b{_TITLE}(?:\s+{_TITLE}\b)?(?:\s+(?i:{'|'.join(re.escape(f) for f in COMPANY_FORMS)}))?(?!\w)",
    "GPE": rf"\w*(?:{'|'.join(PLACES)})\w*",
    "PERCENT": r"\b\d+(?:[.,]\d+)*\s*%",
    "MONEY": r"[$€£¥]\s*\d+(?:[.,]\d+)*",
    "DATE": r"(?<![\w.,])\d{4}(?![\w%])",
}


def apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans the longest ones, the first of equal ones; chains of overlaps are short, so each is settled by itself."""
    out, chain, end = [], [], -1
    for span in [*spans, None]:
        if span is None or span[0] >= end:
            taken: list[tuple[int, int, str]] = []
            for s in sorted(chain, key=lambda x: (x[0] - x[1], x[0])):
                if all(s[1] <= x[0] or x[1] <= s[0] for x in taken):
                    taken.append(s)
            out += sorted(taken)
            chain = []
        if span is not None:
            chain.append(span)
            end = max(end, span[1])
    return out


def entities(pages: DataFrame, patterns: dict[str, str] | None = None, tagger: Callable[[str], list[tuple[int, int, str]]] | None = None, longest: bool = False) -> DataFrame:
    """(doc_sha256, page, span_start, span_end, text, label): what patterns match, or what a tagger says.

    longest: of matches that overlap only the longest stays, of equal ones the first. Spans are code points. The tagger is a plain function: `tokens.entities` has rules over English tokens, and a trained model has its place here.
    """
    if tagger is None:

        def tagger(t: str, found=tuple((patterns or {}).items())):
            every = sorted((m.start(), m.end(), k) for k, p in found for m in re.finditer(p, t))
            return apart(every) if longest else every

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            for part in slices(batch):
                found = [(k, s, e, t[s:e], label) for k, t in enumerate(part.column(2).to_pylist()) if t for s, e, label in tagger(t)]
                row, *spans = zip(*found) if found else [()] * 5
                own = [part.column(k).take(pa.array(row, pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, spans, kinds)], names=["doc_sha256", "page", "span_start", "span_end", "text", "label"])

    return pages.select("doc_sha256", F.col("page").cast("int").alias("page"), "text").mapInArrow(run, "doc_sha256 string, page int, span_start int, span_end int, text string, label string")


def entity_coverage(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Share of English documents with an entity; 1 if there are none."""
    english = majority_lang(pages, "doc_sha256").filter("lang = 'en'").select("doc_sha256")
    hit = english.join(found.select("doc_sha256").distinct(), "doc_sha256", "left_semi").agg(F.count("*").alias("covered"))
    return english.agg(F.count("*").alias("docs")).join(hit, F.lit(True)).select("docs", "covered", F.when(F.col("docs") == 0, F.lit(1.0)).otherwise(F.col("covered") / F.col("docs")).alias("coverage"))


def news_text(columns: list[str]):
    """The first of body, text, content, description that is not blank, else title and summary."""
    first = [F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in ("body", "text", "content", "description") if c in columns]
    title = F.col("title") if "title" in columns else F.lit("")
    rest = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("snippet", "summary") if c in columns], F.lit(""))
    return F.coalesce(*first, F.nullif(F.trim(F.concat_ws(". ", F.nullif(F.trim(title), F.lit("")), F.nullif(rest, F.lit("")))), F.lit("")))
