"""Ranked lexical search over an inverted index in shards of documents.

The index is built where documents are read: a shard is a stretch of about ``SHARD_BYTES`` of text, its documents are
ordered by id, and each of its terms has one row of postings, places and counts as delta-coded variable-length integers.
No text is shuffled.  A search takes the postings of the queries' terms to one task for each shard and
goes through them document by document: a heap merges the lists' heads in order of documents, and a heap of the best
results, by score and then id, gives the score that has to be reached.  Lists whose greatest contributions together
do not reach it need no merging: they are looked up for the documents that others bring.  The best of all tasks meet in
one merge for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import column, cut, forget, give_back, prepare, rows_with, shuffle_parts, slices, text_bytes, whole_groups
from .words import LOWER, span_hash

#: Bytes of text in a shard, about; of a text that is cut into terms at once; rows of postings that are handed on at once.
SHARD_BYTES, PORTION, ROWS = 16 << 20, 2 << 20, 16384
#: Terms of a block of queries, about: what the driver and every task hold of queries at a time.
QUERY_TERMS = 200_000
#: A term is a longest run of these; beyond ASCII everything belongs to terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INSIDE = np.ones(256, bool)
_INSIDE[:128] = [chr(b).isalnum() for b in range(128)]
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def encode_ints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the last byte below 128: (bytes, bytes of each value)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - size
    for k in range(int(size.max()) if len(size) else 0):
        has = np.flatnonzero(size > k)
        low = (values[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[start[has] + k] = low | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def decode_ints(data: np.ndarray) -> np.ndarray:
    """The values of ``encode_ints``, of any number of rows behind each other."""
    last = np.flatnonzero(data < 128)
    start = np.append(0, last[:-1] + 1) if len(last) else last
    size = last - start + 1
    out = np.zeros(len(last), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        has = np.flatnonzero(size > k)
        out[has] |= (data[start[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.view(np.int64)


def _binary(data: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)
    return data[at]


class ShardBuilder:
    """Collects the terms of documents, portion by portion, and makes the rows of a shard."""

    def __init__(self, shard: int):
        self.shard, self.size, self.ids = shard, 0, []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.names: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: list, texts: pa.Array) -> None:
        data, offsets = text_bytes(texts)
        first = len(self.ids)
        self.ids += ids
        self.size += len(data)
        at = 0
        while at < len(data):
            end = min(at + PORTION, len(data))
            if end < len(data):  # a portion ends between terms
                rest = np.flatnonzero(~_INSIDE[data[end : end + 4096]])
                while not len(rest) and end + 4096 < len(data):
                    end += 4096
                    rest = np.flatnonzero(~_INSIDE[data[end : end + 4096]])
                end = end + int(rest[0]) if len(rest) else len(data)
            self._portion(LOWER[data[at:end]], offsets - at, first)
            at = end

    def _portion(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        inside = _INSIDE[data]
        edge = np.zeros(len(data) + 1, bool)
        own = offsets[(offsets >= 0) & (offsets <= len(data))]
        edge[own] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if not len(starts):
            return
        doc = first + np.searchsorted(offsets, starts, "right") - 1
        hashes, at, term = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        pair, count = np.unique(doc * len(hashes) + term, return_counts=True)
        self.parts.append((hashes[pair % len(hashes)], (pair // len(hashes)).astype(np.int32), count.astype(np.int32)))
        sizes = ends[at] - starts[at]
        self.names.append((hashes, sizes, _gather(data, starts[at], sizes)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The row of the documents, its term null, then one for each term.  Documents without terms are left out."""
        if not self.parts:
            return
        hashes, doc, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        # documents in the order of their ids, those without one last
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        lengths = np.bincount(doc, count, len(self.ids)).astype(np.int64)
        ranked = [i for i in order if lengths[i]]
        place = np.zeros(len(self.ids), np.int64)
        place[ranked] = np.arange(len(ranked))
        doc = place[doc]
        by = np.lexsort((doc, hashes))
        hashes, doc, count = hashes[by], doc[by], count[by]
        # a document in several portions has a term several times
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        count, hashes, doc = np.add.reduceat(count, at), hashes[at], doc[at]
        head = np.ones(len(hashes), bool)
        head[1:] = hashes[1:] != hashes[:-1]
        starts = np.flatnonzero(head)
        n = np.diff(np.append(starts, len(hashes)))
        delta = np.diff(doc, prepend=0)
        delta[starts] = doc[starts]
        docs, docs_size = encode_ints(delta)
        tfs, tfs_size = encode_ints(count)
        names = self._names(hashes[starts])
        length = lengths[ranked]
        coded, coded_size = encode_ints(length)
        ids = pa.array([[self.ids[i] for i in ranked]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([self.shard]), pa.array([None], pa.string()), pa.array([len(ranked)]), pa.array([int(length.sum())]), ids, pa.array([b""]), _binary(coded, np.array([coded_size.sum()]), pa.binary())],
            names=list(_FIELDS),
        )
        docs, tfs = (_binary(d, np.add.reduceat(s, starts), pa.binary()) for d, s in ((docs, docs_size), (tfs, tfs_size)))
        total = np.add.reduceat(count, starts).astype(np.int64)
        for a in range(0, len(starts), ROWS):
            b = min(a + ROWS, len(starts))
            empty = pa.nulls(b - a, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, self.shard)), names[a:b], pa.array(n[a:b]), pa.array(total[a:b]), empty, docs[a:b], tfs[a:b]], names=list(_FIELDS))

    def _names(self, wanted: np.ndarray) -> pa.Array:
        hashes, sizes = (np.concatenate([x[k] for x in self.names]) for k in (0, 1))
        data = np.concatenate([x[2] for x in self.names])
        order = np.argsort(hashes, kind="stable")
        at = order[np.searchsorted(hashes, wanted, sorter=order)]
        return _binary(_gather(data, (np.cumsum(sizes) - sizes)[at], sizes[at]), sizes[at], pa.string())


#: Of the documents' row: their number, their terms in all, their ids, and their lengths in place of counts.
_FIELDS = {"shard": "long", "term": "string", "n": "long", "total": "long", "ids": "array<long>", "docs": "binary", "counts": "binary"}


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all ``docs`` (doc_id, text): (shard, term, n documents, total occurrences, ids, docs, counts).

    A null text has no terms, and a document without terms isn't in the index.  Of each shard one row has no term: it has
    the ids of its documents in order and their lengths.  Rows of equal id are documents of their own; one without an id
    is found like others and comes after them at equal scores.  The index is written (``cut``), as a shard is what one task
reads: computed anew, shards could be others.
    """
    prepare(docs.sparkSession)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        shard = ShardBuilder(task << 32)
        for batch in batches:
            for part in slices(batch, "text", PORTION):
                shard.add(column(part, "doc_id").to_pylist(), column(part, "text"))
                if shard.size >= SHARD_BYTES:
                    yield from shard.rows()
                    made += 1
                    shard = ShardBuilder(task << 32 | made)
                    give_back()
        yield from shard.rows()

    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(built, ", ".join(f"{k} {v}" for k, v in _FIELDS.items())))


class Best:
    """The best ``k`` (score, doc_id), larger scores first and equal ones by ascending id, those without an id last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def bar(self) -> int:
        """The score below which nothing gets in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.k:
            heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapreplace(self.heap, entry)

    def found(self) -> list[tuple[int, int | None]]:
        return [(s, -d if known else None) for s, known, d in sorted(self.heap, reverse=True)]


def merge_lists(lists: list[tuple[int, int, list[int], list[int], dict[int, int]]], ids: list, best: Best) -> None:
    """Offer to ``best`` every document of the lists that may get in, document by document.

    A list is (greatest contribution, weight, documents ascending, factors, factor by document); a document's score is the
    sum of weight times factor over its lists.
    """
    lists = sorted(lists, key=lambda x: x[:2])
    upto = [0]  # what the lists before each one can add at most
    for x in lists:
        upto.append(upto[-1] + x[0])
    many = len(lists)
    bar, lead = best.bar, 0
    while lead < many and upto[lead + 1] < bar:
        lead += 1
    # heads of the lists from ``lead`` on: document * many + list
    at = [0] * many
    heads = [lists[i][2][0] * many + i for i in range(lead, many)]
    heapify(heads)
    while heads:
        doc = heads[0] // many
        score, limit = 0, (doc + 1) * many
        while heads and heads[0] < limit:
            i = heads[0] - doc * many
            _, weight, docs, factors, _ = lists[i]
            p = at[i]
            score += weight * factors[p]
            at[i] = p = p + 1
            if p < len(docs):
                heapreplace(heads, docs[p] * many + i)
            else:
                heappop(heads)
        for i in range(lead - 1, -1, -1):
            if score + upto[i + 1] < bar:
                break
            found = lists[i][4].get(doc)
            if found is not None:
                score += lists[i][1] * found
        if score < bar:
            continue
        best.offer(score, ids[doc])
        bar = best.bar
        if lead < many and upto[lead + 1] < bar:
            while lead < many and upto[lead + 1] < bar:
                lead += 1
            heads = [h for h in heads if h % many >= lead]
            heapify(heads)


class Shard:
    """The documents of a shard and the postings of the queries' terms in it, as lists."""

    def __init__(self, rows: pa.Table, documents: int, occurrences: int):
        head = rows.slice(0, 1)
        self.ids = head.column("ids")[0].as_py()
        lengths = decode_ints(np.frombuffer(head.column("counts")[0].as_py(), np.uint8))
        norm = 25 + 75 * lengths * documents // occurrences
        rows = rows.slice(1).combine_chunks()
        self.lists: dict[str, tuple[int, list[int], list[int], dict[int, int]]] = {}
        if not rows.num_rows:
            return
        n = rows.column("n").to_numpy()
        ends = np.cumsum(n)
        delta, count = (decode_ints(text_bytes(rows.column(c).combine_chunks())[0]) for c in ("docs", "counts"))
        upto = np.cumsum(delta)
        docs = upto - np.repeat(upto[ends - n] - delta[ends - n], n)
        factors = 1_000_000_000 * count // (1000 * count + 8 * norm[docs])
        docs_list, factors_list = docs.tolist(), factors.tolist()
        most = np.maximum.reduceat(factors, ends - n).tolist()
        for k, (term, a, b) in enumerate(zip(rows.column("term").to_pylist(), (ends - n).tolist(), ends.tolist(), strict=True)):
            own, theirs = docs_list[a:b], factors_list[a:b]
            self.lists[term] = (most[k], own, theirs, dict(zip(own, theirs, strict=True)))

    def search(self, terms: list[tuple[str, int]], best: Best) -> None:
        """Offer the documents of this shard; ``terms`` are (term, weight times its repeats in the query)."""
        found = []
        for term, weight in terms:
            if term in self.lists and weight > 0:
                most, *rest = self.lists[term]
                found.append((weight * most, weight, *rest))
        if found:
            merge_lists(found, self.ids, best)


def query_terms(queries: DataFrame) -> DataFrame:
    """(item, term, repeats) of ``queries`` (item, text)."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _AZ, _AZ.lower())
    each = queries.select("item", F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats"))


def search_index(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each row of ``queries`` (item_id, text) with a score over 0.

    ``index`` is of ``build_index``.  Equal rows of ``queries`` are searched once and returned once; rows of equal id and
    different texts have rankings of their own.  A null text finds nothing.  Queries are taken in blocks of about
    ``QUERY_TERMS`` terms, each of which goes over the whole index, so that the queries that the driver and the
    tasks hold are bounded, whatever their number.
    """
    spark = prepare(index.sparkSession)
    items = cut(queries.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))
    terms = cut(query_terms(items))
    totals = index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    blocks = max(1, -(-terms.count() // QUERY_TERMS))
    out = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = _search_block(spark, index, own, totals.n, totals.total, k)
        out = found if out is None else out.unionByName(found)
    forget(terms)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return rows_with(ranked, items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(spark: SparkSession, index: DataFrame, own: DataFrame, documents: int, occurrences: int, k: int) -> DataFrame:
    """(item, score, doc_id): the best of each task, written."""
    matched = cut(rows_with(index.where("term is not null"), own.select("term").distinct(), "term"))
    counted = matched.groupBy("term").agg(F.sum("n").alias("df"))
    # in double precision, as it is stated
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    wanted: dict[int, list[tuple[str, int]]] = {}
    for r in own.join(counted, "term").select("item", "term", (F.col("repeats") * weight).alias("weight")).toLocalIterator():
        wanted.setdefault(r.item, []).append((r.term, r.weight))
    sent = spark.sparkContext.broadcast(wanted)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item in sent.value}
        for held in whole_groups(batches, 1, 1):
            numbers = held.column("shard").to_numpy()
            starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(numbers)), strict=True):
                shard = Shard(held.slice(a, b - a), documents, occurrences)
                for item, terms in sent.value.items():
                    shard.search(terms, best[item])
            give_back()
        rows = [(item, score, doc_id) for item, b in best.items() for score, doc_id in b.found()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item", "score", "doc_id"])

    with_docs = matched.unionByName(index.where("term is null"))
    dealt = with_docs.repartition(shuffle_parts(spark), "shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
    found = cut(dealt.select(*_FIELDS).mapInArrow(searched, "item long, score long, doc_id long"))
    sent.unpersist()
    forget(matched)
    return found


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each item of ``benchmark``."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = search_index(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    forget(index)
    return found


_AT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_SQL = f"""
with postings as (
    select doc_id, term, count(*) as tf from (select doc_id, unnest({_AT}) as term from documents) group by all
), lengths as (
    select doc_id, sum(tf)::bigint as n from postings group by doc_id
), totals as (
    select count(*) as docs, sum(n)::bigint as occurrences from lengths
), frequencies as (
    select term, count(*) as df from postings group by term
), asked as (
    select item_id, term, count(*) as repeats from (select item_id, unnest({_AT}) as term from benchmark) group by all
), weights as (
    select a.item_id, a.term, a.repeats, floor(1000 * ln((2 * t.docs + 2)::double / (2 * f.df + 1)::double))::bigint as w
    from asked a join frequencies f using (term), totals t
), scored as (
    select w.item_id, p.doc_id, sum(w.repeats * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * l.n * t.docs) // t.occurrences))))::bigint as score
    from weights w join postings p using (term) join lengths l using (doc_id), totals t group by all
), ranked as (
    select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scored where score > 0
)
select * from ranked where rank <= 10
"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLES = {"op11_ranked_search": _SQL}
