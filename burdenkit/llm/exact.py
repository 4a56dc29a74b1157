"""Exact deduplication with radix-trie owners.

Every map task folds its own rows into a compressed radix trie and passes on one row per different
text, so copies never travel more than once per task. The rest is dealt by length and content hash to
owner tasks; there the full byte strings, led by length and hash, go into tries whose terminal nodes
hold the identifier that stays. Rows reach an owner in key order, so whenever a trie is over its memory
budget every subtree left of the current key is complete: it is emitted and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import any_names, cut, join_skewed, table, unused


class RadixTrie:
    """Compressed trie from byte strings to [identifier that stays, rows, its payload], kept in terminal nodes."""

    __slots__ = ("keep", "root", "size")

    def __init__(self, keep: str = "min"):
        self.keep, self.root, self.size = keep, [b"", {}, None], 0

    def beats(self, a: int | None, b: int | None) -> bool:
        """Does identifier ``a`` stay rather than ``b``? Null never beats another."""
        if a is None or b is None:
            return b is None and a is not None
        return a < b if self.keep == "min" else a > b

    def insert(self, key: bytes, ident: int | None, rows: int = 1, payload: tuple = ()) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[2] is None:
                    node[2] = [ident, rows, payload]
                elif self.beats(ident, node[2][0]):
                    node[2] = [ident, rows + node[2][1], payload]
                else:
                    node[2][1] += rows
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [ident, rows, payload]]
                self.size += len(key) - at + 200
                return
            label = child[0]
            if not key.startswith(label, at):
                shared = _shared(label, key, at)
                upper = [label[:shared], {label[shared]: child}, None]
                child[0] = label[shared:]
                node[1][key[at]] = upper
                self.size += 200
                child = upper
            node, at = child, at + len(child[0])

    def drain(self) -> Iterator[tuple[bytes, int | None, int, tuple]]:
        """All strings with identifier, rows and payload; the trie is empty afterwards."""
        stack = [(self.root, b"")]
        self.root, self.size = [b"", {}, None], 0
        while stack:
            node, before = stack.pop()
            key = before + node[0]
            if node[2] is not None:
                yield key, *node[2]
            stack.extend((x, key) for x in node[1].values())


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, which differ within ``label``."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


_HEAD = 12
_ROWS = 1000


def _partials(keep: str, budget: int):
    """Map side: columns id, text and payload in; text, best, rows and payload out, a row per different text."""

    def run(batches):
        trie, kinds = RadixTrie(keep), []

        def full():
            rows = list(trie.drain())
            for k in range(0, len(rows), _ROWS):
                part = [(text, best, n, *payload) for text, best, n, payload in rows[k : k + _ROWS]]
                yield _batch(part, ["text", "best", "rows", *names], [pa.binary(), pa.int64(), pa.int64(), *kinds])

        for batch in batches:
            names, kinds = batch.schema.names[2:], batch.schema.types[2:]
            for ident, text, *payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(text, ident, 1, tuple(payload))
                if trie.size > budget:
                    yield from full()
        if kinds or trie.size or trie.root[2]:
            yield from full()

    return run


def _owners(keep: str, budget: int, with_text: bool):
    """Owner side: len, hash, text, best, rows and payload, in order of len and hash."""
    import hashlib

    def run(batches):
        trie, last, kinds = RadixTrie(keep), None, []

        def full():
            rows = list(trie.drain())
            for k in range(0, len(rows), _ROWS):
                part = [(len(key) - _HEAD, hashlib.sha256(memoryview(key)[_HEAD:]).digest(), best, n, *((key[_HEAD:],) if with_text else ()), *payload) for key, best, n, payload in rows[k : k + _ROWS]]
                yield _batch(part, ["len", "sha", "best", "rows", *["text"] * with_text, *names], [pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * with_text, *kinds])

        for batch in batches:
            names, kinds = batch.schema.names[5:], batch.schema.types[5:]
            for n, h, text, best, rows, *payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = n.to_bytes(4, "big") + h.to_bytes(8, "big", signed=True)
                if head != last and trie.size > budget:
                    yield from full()  # no later row has an earlier head: all these subtrees are complete
                last = head
                trie.insert(head + text, best, rows, tuple(payload))
        if last is not None:
            yield from full()

    return run


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", carry: tuple[str, ...] = (), with_text: bool = False, budget: int = 48 << 20) -> DataFrame:
    """One row per different text: len (bytes), sha (binary SHA-256), best (identifier that stays), rows.

    ``with_text`` adds the text as binary; ``carry`` adds columns p0, p1, ... with those of the row that stays.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(carry)])
    more = [StructField(f"p{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]

    def fields(ddl: str) -> StructType:
        return StructType([*StructType.fromDDL(ddl), *more])

    parts = rows.mapInArrow(_partials(keep, budget), fields("text binary, best long, rows long"))
    dealt = parts.select(F.octet_length("text").cast("long").alias("len"), F.xxhash64("text").alias("hash"), *parts.columns).repartition("len", "hash")
    out = fields("len long, sha binary, best long, rows long" + ", text binary" * with_text)
    return dealt.sortWithinPartitions("len", "hash").mapInArrow(_owners(keep, budget, with_text), out)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Which row of each group of equal texts stays.

    ``keep``: "min" or "max" identifier. Returns per input row: doc_id, keep_id, group_size, kept and
    text_sha256; other columns take no part, whatever their names. Null texts count as empty, and texts of
    any length are compared whole; a null id stays only in a group without other ids. Of rows that repeat
    both id and text exactly one is kept. An empty table gives an empty result.
    """
    owners = cut(text_owners(docs, id_col, text_col, keep).select(F.lower(F.hex("sha")).alias("text_sha256"), F.col("len").alias("_len"), F.col("best").alias("keep_id"), F.col("rows").alias("group_size")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("_len"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    # of rows that repeat the identifier that stays, the first; summed on the map side, so a large group is no large task
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")) if keep == "min" else F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_row"))
    stays = rows.groupBy("text_sha256", "_len").agg(best["_row"].alias("_stays"))
    owners = cut(owners.join(stays, ["text_sha256", "_len"]))
    out = join_skewed(rows, owners, ["text_sha256", "_len"], "group_size", "_row")
    return out.select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_stays")).alias("kept"), "text_sha256")


@any_names
def drop_exact_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """``docs`` (with doc_id and text) without the rows whose text another row owns; all columns as before.

    The texts travel once: the owner tasks return the rows that stay. Nulls, ties, repeats, long texts and empty
    tables as in ``exact_duplicates``; other columns may have any names.
    """
    carry, null = tuple(c for c in docs.columns if c != "text"), unused(docs, "no_text")
    marked = docs.withColumn(null, F.col("text").isNull())
    owned = text_owners(marked, keep=keep, carry=(*carry, null), with_text=True)
    text = F.when(~F.col(f"p{len(carry)}"), F.col("text").cast("string"))
    at = {c: F.col(f"p{i}") for i, c in enumerate(carry)}
    return owned.select(*[(text if c == "text" else at[c]).alias(c) for c in docs.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_duplicates`` over ``documents``, the largest doc_id staying; nulls, ties and odd rows as there."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
