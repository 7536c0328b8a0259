"""MinHash near-duplicates (operator 1).

1. A document's set: the distinct hashes (64 bits) of its 5-word shingles. Equal sets form
   a class, named by its least doc_id; only classes go on, so copies cost nothing later.
2. Signatures: minima under universal hashes (multiply, add, keep the high bits), in bands
   of ROWS minima, as many that a pair at the threshold p meets in none of them with a chance
   (1 - p ** ROWS) ** bands of at most MISS: 18 bands at 0.85, 25 at 0.80.
3. Star links: every member of a bucket is compared with the bucket's least member only;
   signatures that agree too little (SLACK standard errors) go no further, the others are
   confirmed on the full sets. Components of these links: alternating stars.
4. What is left are buckets that still hold several components, each set of members once
   however many bands it meets in. Members are dealt by size of their sets, so that only like
   sizes meet, and at random into chunks of about CHUNK_ROWS members and CHUNK_SHINGLES
   shingles. Every pair of chunks is one task: it counts the common shingles of all its pairs
   at once by a product of incidence matrices and returns only links that join two components.
   So no link between different texts is lost and no group is expanded into pairs of rows.
5. Components of all links, carried back to the documents.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. With fewer than
five words the whole sequence is the one shingle; a row with a null or empty text, or one
without words, has an empty set and is linked with nothing. Rows that repeat a doc_id are one node: each row gets its own
n_shingles and the component of the node. A row with a null doc_id is returned with its
n_shingles, takes part in nothing, has a null component and is kept. An empty table gives
an empty result; other columns are not read. A very long text is hashed as a whole, by one task.
Ids may be any 64-bit number. Shingles are compared as 64-bit hashes, in which every byte counts
by its place: two different ones are equal with a chance of 2 ** -64.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import Scratch, flat_text, mix64, slices, word_hashes
from callgrid.llm.components import components

SHINGLE_WORDS = 5
#: Links: 100 * common >= percent * union; PERCENT for op1_minhash, STAGE_PERCENT where
#: near copies are removed.
PERCENT, STAGE_PERCENT = 85, 80
ROWS = 4
MISS = 2e-6
SLACK = 6
CHUNK_ROWS = 256
CHUNK_SHINGLES = 400_000
#: Candidate ids are broadcast to the scan of the texts while they are at most so many.
BROADCAST_IDS = 200_000


def bands(percent: int) -> int:
    p = (percent / 100) ** ROWS
    return math.ceil(math.log(MISS) / math.log1p(-p)) if p < 1 else 1


def universal(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(multiply, add) of so many hashes."""
    r = np.random.default_rng(20_240_501)
    return tuple(r.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(odd) for odd in (1, 0))


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(flat, offsets, lower=True)
    c = np.uint64(0x9E3779B97F4A7C15)
    if len(words) >= k:
        h = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            h *= c
            h += words[j : len(words) - k + 1 + j]
        h = mix64(h ^ np.uint64(k))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        elif b > a:
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    x = x * c + w
                yield mix64(np.array([x ^ (np.uint64(b - a) << np.uint64(32))], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signature(s: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The minima, as 32-bit numbers, of a non-empty set."""
    least = np.full(len(multiply), ~np.uint64(0))
    for i in range(0, len(s), 512):
        part = s[None, i : i + 512] * multiply[:, None]
        part += add[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _signed(hashes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = universal(hashes)
    for batch in batches:
        flat, offsets = flat_text(batch.column(1))
        for i, j in slices(offsets):
            n, digest, sig = [], [], []
            for s in shingle_sets(flat, offsets[i : j + 1]):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, *by).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = flat_text(batch.column(1))
        for i, j in slices(offsets):
            found = list(shingle_sets(flat, offsets[i : j + 1]))
            stops = np.cumsum([0, *map(len, found)])
            values = pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(stops, pa.int32()), values)], names=["id", "shingles"])


def _least_agreement(percent: int) -> int:
    """Equal minima that a pair at the threshold has but for SLACK standard errors."""
    p, hashes = percent / 100, bands(percent) * ROWS
    return max(1, math.floor(hashes * p - SLACK * math.sqrt(hashes * p * (1 - p))))


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, from incidence matrices by slabs."""
    out = np.zeros((len(sets), len(sets)), np.float64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    total = int(shared.sum())
    for a in range(0, total, columns):
        i, j = np.searchsorted(column, [a, a + columns])
        m = np.zeros((len(sets), min(columns, total - a)), np.float32)
        m[owner[i:j], column[i:j] - a] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def _joining_links(percent: int, table: pa.Table) -> pa.Table:
    """Of the members (id, component, shingles) of a pair of chunks: links (u, v) that
    join components, as few as that takes."""
    ids, comp = table["id"].to_numpy(), table["component"].to_numpy()
    none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    if len(ids) < 2 or (comp == comp[0]).all():
        return none
    col = table["shingles"].combine_chunks()
    offs, values = col.offsets.to_numpy(), col.values.to_numpy()
    sets = [values[a:b] for a, b in zip(offs, offs[1:], strict=False)]
    n = np.array(list(map(len, sets)))
    common = common_counts(sets)
    linked = _is_linked(percent, common, n[:, None], n[None, :]) & (comp[:, None] != comp[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    u, v = [], []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root(int(comp[i])), root(int(comp[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            u.append(int(ids[i]))
            v.append(int(ids[j]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _is_linked(percent: int, common, n, m):
    return 100 * common >= percent * (n + m - common)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; linked from percent on."""
    hashes = bands(percent) * ROWS
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.keep(docs.mapInArrow(partial(_signed, hashes), "doc_id long, n_shingles long, digest binary, sig binary"), "signed")
    named = signed.where("doc_id is not null and digest is not null")
    classes = scratch.keep(named.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), "x.sig", "digest"), "classes")

    # buckets of two or more classes, and each member's link with the least of its bucket
    band = lambda k: F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), F.substring("sig", 1 + 4 * ROWS * k, 4 * ROWS)).alias("h"))
    members = classes.select("id", "n", F.explode(F.array(*map(band, range(bands(percent))))).alias("b")).select("id", "n", "b.band", "b.h")
    hubs = members.groupBy("band", "h").agg(F.min(F.struct("id", "n")).alias("hub"), F.max("id").alias("last")).where("hub.id < last")
    # kept apart, so that Spark can split a frequent bucket in the join
    hubs = scratch.keep(hubs, "hubs")
    members = scratch.keep(members.join(hubs.select("band", "h", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), ["band", "h"]), "members")
    pairs = members.where(f"id <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select("id", "hub", "n", "hub_n").distinct()
    sigs = classes.select("id", "sig")
    pairs = pairs.join(sigs, "id").join(sigs.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    agree = sum((F.substring("sig", 1 + 4 * k, 4) == F.substring("hub_sig", 1 + 4 * k, 4)).cast("int") for k in range(hashes))
    pairs = pairs.where(agree >= _least_agreement(percent)).select("id", "hub", "n", "hub_n")

    wanted = scratch.keep(members.select("id").distinct(), "wanted")
    sets = scratch.keep(_texts_of(docs, wanted).mapInArrow(_sets, "id long, shingles array<long>"), "sets")
    full = pairs.join(sets, "id").join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("hub_set")), "hub")
    common = F.size(F.array_intersect("shingles", "hub_set"))
    stars = full.where(_is_linked(percent, common, F.size("shingles"), F.size("hub_set"))).select(F.col("id").alias("u"), F.col("hub").alias("v"))
    first = scratch.keep(components(stars, scratch), "first")

    # buckets that still hold several components: all pairs of chunks of like sizes, counted in blocks
    at = members.select("band", "h", "id", "n", _step(F.col("n"), percent).alias("step")).join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = at.groupBy("band", "h", "step").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("c"), F.sum("n").alias("s"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"))
    chunks = F.ceil(F.greatest(F.col("c") / CHUNK_ROWS, F.col("s") / CHUNK_SHINGLES)).cast("int")
    split = sizes.groupBy("band", "h").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("c").alias("c"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"), F.collect_list(F.struct("step", chunks.alias("chunks"))).alias("sizes")).where("a < b")
    # buckets of several bands that hold the same members are compared once
    split = split.groupBy("c", "x", "y").agg(F.min(F.struct("band", "h")).alias("k"), F.min_by("sizes", F.struct("band", "h")).alias("sizes"))
    split = scratch.keep(split.select("k.band", "k.h", F.map_from_entries("sizes").alias("sizes")), "split")
    at = at.join(split, ["band", "h"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("sizes")[F.col("step")]).cast("int"))
    at = at.withColumn("block", F.explode(_blocks())).select("band", "h", "block.*", "id", "component")

    def joining(table: pa.Table) -> pa.Table:
        return _joining_links(percent, table)

    more = at.join(sets, "id").groupBy("band", "h", "low", "i", "high", "j").applyInArrow(joining, "u long, v long")
    # a doc_id on rows of several classes joins them
    twice = named.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    same = named.join(twice, "doc_id").join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    links = first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more).union(same)
    joined = components(links, scratch)
    for used in (hubs, members, wanted, sets, first, split):
        scratch.drop(used)

    named = classes.select("digest", F.col("id").alias("node")).join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("of_class"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _step(n: Column, percent: int) -> Column:
    """The size class of a set: linked sets are in the same class or in neighbouring ones."""
    return F.floor(F.log(n) / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else n.cast("int")


def _blocks() -> Column:
    """For a member (step, chunk, sizes: chunks by step), the pairs of chunks that it takes part in."""

    def each(step: Column, block) -> Column:
        n = F.coalesce(F.col("sizes")[step], F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.struct(*(x.alias(y) for x, y in zip(block(k), ("low", "i", "high", "j"), strict=True))))).otherwise(F.array())

    step, chunk = F.col("step"), F.col("chunk")
    return F.concat(
        each(step, lambda k: (step, F.least(chunk, k), step, F.greatest(chunk, k))),
        each(step + 1, lambda k: (step, chunk, step + 1, k)),
        each(step - 1, lambda k: (step - 1, k, step, chunk)),
    )


def _bounded(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast while it is small; else joined by a merge."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs whose id is wanted."""
    return docs.join(_bounded(wanted).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of docs, all columns, without the near copies of an earlier document. Of rows
    that repeat a doc_id, one of those whose text has the least hash stays."""
    scratch = Scratch(docs.sparkSession)
    judged = scratch.keep(near_duplicates(docs, id_col, text_col, percent, scratch).where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept"), "judged")
    scratch.keep_only(judged)
    again = judged.where("kept").select(id_col)
    once = docs.join(_bounded(judged.select(id_col)), id_col, "left_anti")
    th = "__minhash_th"
    rest = docs.join(_bounded(again), id_col, "left_semi").withColumn(th, F.xxhash64(text_col))
    least = rest.groupBy(id_col).agg(F.min(th).alias(th))
    rest = rest.join(least.withColumnRenamed(id_col, "__minhash_id"), (F.col(id_col) == F.col("__minhash_id")) & (rest[th] == least[th]), "left_semi").drop(th)
    return once.unionByName(rest.dropDuplicates([id_col]))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Exact links and reachability for DuckDB, for small tables.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \t\n\x0B\x0C\r]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) END AS sh FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.v, r.root FROM r JOIN e ON r.id = e.u),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
