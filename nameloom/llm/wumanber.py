"""Evaluation passages inside training texts by Wu-Manber multi-pattern search (problem 8).

Texts are compared as the stream of their letters and digits, in one case and
width. The patterns are the windows of each item: 12 consecutive words, or 24
consecutive characters for items in zh. All windows share one table: for each
block of B characters that occurs in the first m characters of a pattern (m: the
shortest pattern), how far the search may skip when it sees that block; blocks
that no pattern holds skip m-B+1. Where the skip is zero, the block stands at the
end of a pattern's first m characters, a hash bucket of those characters selects
the patterns, and a direct comparison confirms them.

The items are a fixed, small set. They are sent to the executors in blocks of
bounded size; each block is one pass over the corpus, so a larger set costs more
passes, not more memory.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, CHARACTERS = 12, 24
#: Characters of item text in one broadcast block of items; the tables take some hundred bytes for each.
BLOCK_CHARS = 200_000
_APART = re.compile(r"[\W_]+")
_HAN_LANGS = ("zh",)


def stream_of(text: str) -> str:
    """Letters and digits of a text, in one width and case."""
    return _APART.sub("", unicodedata.normalize("NFKC", text).casefold())


def windows(text: str, lang: str | None, words: int = WORDS, characters: int = CHARACTERS) -> set[str]:
    """The pieces of an item that a document must hold one of. An item shorter than a window has none."""
    if (lang or "").strip().lower().split("-")[0] in _HAN_LANGS:
        s = stream_of(text)
        return {s[i : i + characters] for i in range(len(s) - characters + 1)}
    w = [x for x in map(stream_of, text.split()) if x]
    return {"".join(w[i : i + words]) for i in range(len(w) - words + 1)}


class Searcher:
    """Shift table and suffix buckets over patterns {pattern: item ids}."""

    def __init__(self, patterns: dict[str, set[int]]) -> None:
        self.m = m = min(map(len, patterns), default=0)
        self.block = b = min(4, m)
        self.shift: dict[str, int] = {}
        self.bucket: dict[int, list[tuple[str, list[int]]]] = {}
        for p in sorted(patterns):
            head = p[:m]
            for end in range(b, m + 1):
                piece = head[end - b : end]
                self.shift[piece] = min(self.shift.get(piece, m), m - end)
            self.bucket.setdefault(hash(head), []).append((p, sorted(patterns[p])))
        self.far = m - b + 1

    def find(self, text: str) -> set[int]:
        """Ids of all items of which a pattern stands in text."""
        m, b, far, shift, bucket = self.m, self.block, self.far, self.shift, self.bucket
        found: set[int] = set()
        if not m:
            return found
        end, n = m, len(text)
        while end <= n:
            skip = shift.get(text[end - b : end], far)
            if skip:
                end += skip
                continue
            start = end - m
            for pattern, ids in bucket.get(hash(text[start:end]), ()):
                if text.startswith(pattern, start):
                    found.update(ids)
            end += 1
        return found


def item_blocks(items: DataFrame, ident: str, text: str, lang: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str, str | None]]]:
    """The items in blocks of at most block_chars characters (one item at least), read row by row, never all at once."""
    block, size = [], 0
    for row in items.where(F.col(text).isNotNull() & F.col(ident).isNotNull()).select(ident, text, lang).toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1], row[2]))
        size += len(row[1])
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", item_lang: str = "lang", words: int = WORDS, characters: int = CHARACTERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): every document whose text holds a window of the item, once for each pair.

    Whole texts are searched. Null or empty texts and items shorter than a window
    give no row; an item with a null language is taken as one of words. Repeated
    documents give a row for each different id.
    """
    schema = f"{doc_id} bigint, {item_id} bigint"
    rows = docs.where(F.col(doc_text) != "").select(F.col(doc_id).cast("bigint"), F.col(doc_text))
    out = None
    for block in item_blocks(items, item_id, item_text, item_lang, block_chars):
        by_len: dict[bool, dict[str, set[int]]] = {True: {}, False: {}}
        for ident, text, lang in block:
            # windows of words are much longer than those of characters, so each kind gets its own table and skips as far as it can
            kind = (lang or "").strip().lower().split("-")[0] in _HAN_LANGS
            for w in windows(text, lang, words, characters):
                by_len[kind].setdefault(w, set()).add(ident)
        tables = [p for p in by_len.values() if p]
        if not tables:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(tables)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = [Searcher(p) for p in sent.value]
            for batch in batches:
                ids, hits = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = stream_of(t)
                    for x in sorted(set().union(*(k.find(s) for k in own))):
                        ids.append(i)
                        hits.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], names=[doc_id, item_id])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, split, lang, documents): how many documents each leaked item stands in."""
    found = leaks(docs, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return found.join(items.select("item_id", "split", "lang"), "item_id")
