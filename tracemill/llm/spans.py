"""Long verbatim spans that documents share (problem 10).

Content-defined chunking: a gear rolling hash over the last ``GEAR`` characters is taken at every character, and a
chunk border is where the hash is least (rightmost, if tied) among some ``NEAR`` consecutive ones. Borders depend on
nearby content only, so insertions shift no chunk. Within any span of ``SPAN`` characters there are three windows of
``NEAR`` hashes that don't overlap, hence three borders that every copy of the span has, with the same borders between
them: at least one pair of consecutive chunks is the same in all copies. So documents are joined on
the digests of chunk pairs without losing any span, and only text around digests of two or more
documents is compared, exactly.

Each text is chunked once; digests and places are kept in the checkpoint folder, one row a document, and what is
carved from the texts later goes by those places. Comparing is linear, never by pairs: a digest's documents send the text around it to the group
of digests that begin in the same ``REACH`` characters of the least document that has it. So overlapping text goes
once, and a group is bounded: by the digests of that stretch, of ``HOT`` documents each at most. It sorts the hashes of all
windows of ``SPAN`` characters there and then compares the characters themselves. A digest of more than ``HOT`` documents is
compared by distributed aggregations instead: texts around it that several documents have are shared as a whole, and
each distinct one of the others goes through an aggregation over the hashes of its windows.

Defined results
* Characters are Unicode code points, compared as they are. Null texts and texts shorter than ``SPAN`` share nothing.
* A span repeated within one document only isn't shared. Equal documents share all their text.
* Rows with the same doc_id are one document and don't share with each other; null doc_ids are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.runtime import cut, map_batches, table

SPAN, GEAR, HOT, REACH = 300, 32, 1000, 8192
#: Characters that are chunked together.
SLICE = 1 << 20
_BASES = (np.uint64(6364136223846793005), np.uint64(0x9E3779B97F4A7C15))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def near(span: int) -> int:
    """The largest number of hashes in a window that leaves three of them in any span."""
    return (span - GEAR + 1) // 3


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gear(codes: np.ndarray) -> np.ndarray:
    """The rolling hash of each ``GEAR`` characters; the first is that of codes[:GEAR]."""
    h = codes * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    h ^= h >> np.uint32(13)
    step = 1
    while step < GEAR:
        h = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def chunk_pairs(texts: list[str], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, start, end) of each two consecutive chunks of the texts, all in one array.

    Chunks begin at places of least hashes: of each window of hashes within a text the rightmost least one.
    """
    w = near(span)
    none = np.zeros(0, np.int64)
    codes = [code_points(t) for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    whole = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    if len(whole) < GEAR + w - 1:
        return none, none, none, none
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    h = gear(whole).astype(np.uint64)
    # the place is part of the value, so that the rightmost of equal hashes is the least
    v = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    done = 1
    while done < w:
        step = min(done, w - done)
        v = np.minimum(v[step:], v[:-step])
        done += step
    inside = owner[: len(v)] == owner[GEAR + w - 2 : GEAR + w - 2 + len(v)]
    place = (np.uint64(0xFFFFFFFF) - (v[inside] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    # windows slide, so places never fall
    at = place[np.concatenate([[True], place[1:] != place[:-1]])] + GEAR - 1 if len(place) else none
    if len(at) < 3:
        return none, none, none, none
    step = np.diff(np.append(at, at[-1] + 1))
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(w + 1, _BASES[0], np.uint64)]))
    power = up[np.minimum(np.arange(at[0], at[-1] + 1) - np.repeat(at, step), w + 1)]
    one = np.add.reduceat((whole[at[0] : at[-1] + 1].astype(np.uint64) + np.uint64(7)) * power, at - at[0])
    both = one[:-2] + up[np.minimum(step[:-2], w + 1)] * one[1:-1]
    both = (both ^ (both >> np.uint64(31))) * _BASES[1]
    same = owner[at[:-2]] == owner[at[2:]]
    text, first = owner[at[:-2]][same], np.concatenate([[0], ends[:-1]])
    return text, (both ^ (both >> np.uint64(29))).view(np.int64)[same], at[:-2][same] - first[text], at[2:][same] - first[text]


def slices(texts: list[str]) -> list[tuple[int, int]]:
    """Runs of texts of about ``SLICE`` characters together."""
    out, start, n = [], 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= SLICE or i == len(texts) - 1:
            out.append((start, i + 1))
            start, n = i + 1, 0
    return out


def _ladder(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        r = _BASES[base]
        inverse = np.uint64(pow(int(r), -1, 1 << 64))
        size = max(n, 65_536)
        _powers[base] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64))]) for x in (r, inverse))
    return _powers[base]


def window_hashes(codes: np.ndarray, span: int = SPAN, base: int = 0) -> np.ndarray:
    """A polynomial hash of each window of ``span`` characters."""
    if len(codes) < span:
        return np.zeros(0, np.uint64)
    up, down = _ladder(len(codes) + 1, base)
    total = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * up[: len(codes)])])
    h = (total[span:] - total[:-span]) * down[: len(codes) - span + 1]
    return h ^ (h >> np.uint64(29))


def _runs(flags: np.ndarray, span: int) -> list[tuple[int, int]]:
    """The stretches of characters that windows starting at the flagged places cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > span)
    return [(int(a), int(b) + span) for a, b in zip(at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])])]


def shared_stretches(docs: list[int], offsets: list[int], texts: list[str], span: int = SPAN) -> list[tuple[int, int, int]]:
    """(doc, start, end) of the stretches of the texts that stand in the text of another doc too, by hash and then by character."""
    codes = [code_points(t) for t in texts]
    hashes = [window_hashes(c, span) for c in codes]
    if not hashes or not sum(map(len, hashes)):
        return []
    h = np.concatenate(hashes)
    which = np.repeat(np.arange(len(texts)), [len(x) for x in hashes])
    place = np.concatenate([np.arange(len(x)) for x in hashes])
    _, doc_no = np.unique(np.array(docs), return_inverse=True)
    doc = doc_no[which]
    order = np.lexsort((doc, h))
    first = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    group = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(order)) - 1
    lowest, highest = order[heads][group], order[tails][group]
    # the partner is the group's first window, or its last for windows of the first's doc
    partner = np.empty(len(h), np.int64)
    partner[order] = np.where(doc[order] != doc[lowest], lowest, highest)
    flags = doc[partner] != doc
    # runs of windows whose partners are consecutive windows of one text: one comparison of characters each
    goes_on = np.zeros(len(h) + 1, bool)
    goes_on[1:-1] = flags[1:] & flags[:-1] & (np.diff(which) == 0) & (np.diff(partner) == 1) & (np.diff(which[partner]) == 0)
    for s, e in zip(np.flatnonzero(flags & ~goes_on[:-1]).tolist(), np.flatnonzero(flags & ~goes_on[1:]).tolist()):
        own, other = codes[which[s]], codes[which[partner[s]]]
        i, q, n = place[s], place[partner[s]], e - s
        if not np.array_equal(own[i : i + n + span], other[q : q + n + span]):
            for x in range(n + 1):
                flags[s + x] = np.array_equal(own[i + x : i + x + span], other[q + x : q + x + span])
    out, i = [], 0
    for d, o, x in zip(docs, offsets, hashes):
        out += [(d, o + a, o + b) for a, b in _runs(flags[i : i + len(x)], span)]
        i += len(x)
    return out


def _table(names: str, rows: list, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names.split())


def marked(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, keys, places): the chunk pairs of each text.

    A place is one number, of which the lowest bit tells a key's first time in the text, then come 16 bits of length, 31 of the start and
    15 of ``row``, which tells the rows of one doc_id apart (were two alike, each would be searched around the places of both).
    """

    def chunk(batch: pa.RecordBatch) -> pa.Table:
        docs, rows, every, out = batch.column(0), np.array(batch.column(1)).astype(np.int64) & 0x7FFF, batch.column(2).to_pylist(), []
        for lo, hi in slices(every):
            text, key, start, end = chunk_pairs(every[lo:hi], span)
            order = np.lexsort((start, key, text))
            first = np.ones(len(order), np.int64)
            first[order[1:][(key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])]] = 0
            place = rows[lo:hi][text] << 48 | start << 17 | (end - start) << 1 | first
            at = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (key, place)]
            out.append(pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo), *lists], names=["doc_id", "keys", "places"]))
        return pa.Table.from_batches(out)

    return map_batches(texts.select("doc_id", "row", "text"), chunk, "doc_id long, keys array<long>, places array<long>")


def carved(texts: DataFrame, marks: DataFrame, hot: int, span: int) -> DataFrame:
    """(least, reach, doc_id, start, part): the text around digests of several documents, for the group that compares it; crowded ones have no group."""
    each = marks.select("doc_id", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"))))
    start = lambda place: F.shiftright(place, 17).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    groups = each.where(F.col("place").bitwiseAND(F.lit(1)) == 1).groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"), F.min_by("place", "doc_id").alias("place")).where("least <> most")
    usual = F.col("n") <= hot
    chosen = groups.select("key", F.when(usual, F.col("least")).alias("least"), F.when(usual, F.floor(start(F.col("place")) / REACH).cast("int")).alias("reach"))
    # a document has no more of them than characters
    row = F.shiftright("place", 48).cast("int")
    marks_of = F.array_sort(F.collect_list(F.struct("least", "reach", start(F.col("place")).alias("start"), F.shiftright("place", 1).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("n"))))
    member = each.join(chosen, "key").groupBy("doc_id", row.alias("row")).agg(marks_of.alias("marks"))

    def around(text: str, found: list[dict]) -> list[tuple[int | None, int | None, int, str]]:
        out: list[list] = []
        for m in found:
            lo, hi = max(0, m["start"] + m["n"] - span), min(len(text), m["start"] + span)
            if out and out[-1][0] == m["least"] and out[-1][1] == m["reach"] and lo <= out[-1][3] - span + 1:
                out[-1][3] = max(hi, out[-1][3])
            else:
                out.append([m["least"], m["reach"], lo, hi])
        return [(g, r, lo, text[lo:hi]) for g, r, lo, hi in out if hi - lo >= span]

    def carve(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for d, t, found in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [(g, r, d, lo, part) for g, r, lo, part in around(t, found)]
        return _table("least reach doc_id start part", rows, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()))

    joined = texts.withColumn("row", F.col("row").bitwiseAND(F.lit(0x7FFF))).join(member, ["doc_id", "row"]).select("doc_id", "text", "marks")
    return map_batches(joined, carve, "least long, reach int, doc_id long, start int, part string")


def crowded_stretches(parts: DataFrame, span: int) -> DataFrame:
    """(doc_id, start, end) of what parts (doc_id, start, part) of any number of documents have in common, as aggregations.

    Parts that several documents have are shared as they are. Of each distinct one windows are compared with those of all others.
    """
    keyed = parts.withColumn("id", F.xxhash64("part", F.lit(1))).withColumn("check", F.xxhash64("part", F.lit(2)))
    one = ["id", "check"]
    distinct = keyed.groupBy(*one).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("part").alias("part"))

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
        for i, c, a, b, t in zip(*(batch.column(x).to_pylist() for x in (*one, "least", "most", "part"))):
            codes = code_points(t)
            h, g = (window_hashes(codes, span, base).view(np.int64) for base in (0, 1))
            for col, x in zip(cols, (h, g, np.full(len(h), i), np.full(len(h), c), np.full(len(h), a), np.arange(len(h)))):
                col.append(x)
            if a != b:  # a second document has them all
                for col, x in zip(cols, (h, g, np.full(len(h), i), np.full(len(h), c), np.full(len(h), b), np.full(len(h), -1))):
                    col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["h", "g", *one, "doc_id", "at"])

    every = map_batches(distinct, windows, "h long, g long, id long, check long, doc_id long, at long")
    common = every.groupBy("h", "g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h", "g")
    flags = every.where("at >= 0").join(common, ["h", "g"]).groupBy(*one, F.floor(F.col("at") / REACH).alias("blk")).agg(F.array_sort(F.collect_set("at")).alias("places"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, c, places in zip(*(batch.column(x).to_pylist() for x in (*one, "places"))):
            at = np.array(places)
            cuts = np.flatnonzero(np.diff(at) > span)
            rows += [(i, c, int(a), int(b) + span) for a, b in zip(at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])])]
        return _table("id check from to", rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))

    runs = map_batches(flags, run, "id long, check long, `from` int, `to` int")
    return keyed.drop("part").join(runs, one).select("doc_id", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))


def shared_spans(documents: DataFrame, span: int = SPAN, hot: int = HOT) -> DataFrame:
    """(doc_id, start, end), the stretches of each document, apart from each other, that lie in spans shared with others."""
    texts = documents.where("doc_id is not null").where(F.length("text") >= span).select("doc_id", F.hash("text").alias("row"), "text")
    parts = carved(texts, cut(marked(texts, span)), hot, span)

    def compare(group: pa.Table) -> pa.Table:
        docs, starts, pieces = (group.column(c).to_pylist() for c in ("doc_id", "start", "part"))
        rows = shared_stretches(docs, starts, pieces, span) if len(set(docs)) > 1 else []
        return pa.Table.from_batches([_table("doc_id start end", rows, (pa.int64(), pa.int32(), pa.int32()))])

    usual = parts.where("least is not null").groupBy("least", "reach").applyInArrow(compare, "doc_id long, start int, end int")
    return merge(usual.unionByName(crowded_stretches(parts.where("least is null").select("doc_id", "start", "part"), span)))


def merge(stretches: DataFrame) -> DataFrame:
    """Unite the overlapping and touching stretches of each document; a document has no more of them than characters."""
    fold = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return stretches.groupBy("doc_id").agg(fold.alias("s")).select("doc_id", F.inline("s"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    spans = shared_spans(table(spark, base, "documents"))
    return spans.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("shared_chars"))


def p10_spans(spark: SparkSession, base: str) -> DataFrame:
    """The spans themselves, and the share of each document that they are."""
    documents = table(spark, base, "documents")
    spans = shared_spans(documents)
    return spans.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "start", "end", F.md5(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("span_md5"), F.round((F.col("end") - F.col("start")) / F.length("text"), 6).alias("share"))
