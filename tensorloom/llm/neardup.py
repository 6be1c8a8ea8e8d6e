"""Near duplicates: b-bit MinHash signatures, a multi-index Hamming join, and a check on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, lower_ascii, mix, ngram_hashes, slices, utf8, word_hashes
from tensorloom.llm.graph import components

#: Documents whose ids are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
#: Shingles of a block's members together, on average.
BLOCK_SHINGLES = 1 << 20


@dataclass(frozen=True)
class Scheme:
    """Words in a shingle, similarity in percent, and the signature: `chunks` chunks of `width` values of 16 bits, up to
    `errors` of which may differ in a chunk.

    Two signatures that differ in at most `distance` values have a chunk with at most `errors` differing values (else
    each chunk would have errors + 1). At 85 % a value differs with probability 0.15, so that 60 values differ in 9 on
    average, and in more than 23 for about 3 of a million pairs exactly at the limit.
    """

    words: int = 5
    percent: int = 85
    chunks: int = 12
    width: int = 5
    errors: int = 1

    @property
    def values(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        return self.chunks * (self.errors + 1) - 1


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a text with fewer words has one, over all of them."""
    data, offsets = utf8(column)
    w, bounds = word_hashes(lower_ascii(data), offsets)
    h, row = ngram_hashes(w, bounds, tuple(range(1, words)), salt=words)
    cuts = np.searchsorted(row, np.arange(1, len(column)))
    out = [np.unique(x) for x in np.split(h, cuts)]
    for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < words)):
        own = w[bounds[i] : bounds[i + 1]]
        out[i] = np.asarray([xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own))], np.uint64)
    return out


def _multipliers(values: int) -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, 2 * values + 1, dtype=np.uint64)
    h = mix(mix(seed * np.uint64(0x9E3779B97F4A7C15)))
    return h[:values] | np.uint64(1), h[values:]


def signature(shingles: np.ndarray, values: int) -> np.ndarray:
    """16 bits of the smallest image of the set under each of `values` hash functions."""
    a, b = _multipliers(values)
    least = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[k : k + 4096, None] * a + b).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype("<u2")


def signed(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, n_shingles, set_id (a 128-bit digest of the whole set; null if empty) and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), scheme.words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, scheme.values).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_id", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary")


def _signatures(column: pa.Array, values: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, values)


def chunk_keys(reps: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, rep): for each chunk and each choice of `errors` values to leave out, a hash of the values that stay.

    Two signatures agree in one of a chunk's keys if and only if at most `errors` of its values differ.
    """
    left = [(c, keep) for c in range(scheme.chunks) for keep in combinations(range(scheme.width), scheme.width - scheme.errors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sig = _signatures(part.column("sig"), scheme.values).astype(np.uint64)
                keys = np.empty((len(sig), len(left)), np.uint64)
                for j, (c, keep) in enumerate(left):
                    h = np.full(len(sig), j + 1, np.uint64)
                    for i in keep:
                        h = mix(h + sig[:, c * scheme.width + i])
                    keys[:, j] = h
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), len(left)))], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def within_distance(pairs: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most `scheme.distance` values and whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = (_signatures(batch.column("sa"), scheme.values) != _signatures(batch.column("sb"), scheme.values)).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(apart <= scheme.distance))

    end = lambda e: classes.select(F.col("rep").alias(e), F.col("sig").alias(f"s{e}"), F.col("n_shingles").alias(f"n{e}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b").where(100 * F.least("na", "nb") >= scheme.percent * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _full_sets(ids: DataFrame, docs: DataFrame, scheme: Scheme, arrays: bool = False) -> DataFrame:
    """(rep, shingles): the whole sets of the documents in `ids` (rep), as ascending hashes: their bytes, or an array of longs."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.view(np.int64) if arrays else s.tobytes() for s in shingle_sets(batch.column("text"), scheme.words)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.list_(pa.int64()) if arrays else pa.binary())], names=["rep", "shingles"])

    found = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep")
    return found.mapInArrow(make, "rep long, shingles " + ("array<long>" if arrays else "binary"))


def confirmed(pairs: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity: 100 * common >= percent * union.

    Pairs whose sizes alone forbid it go before the sets are sent; the sets meet row by row on the JVM, so that no batch of
    long sets is ever held.
    """
    pairs = checkpointed(pairs)
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), docs, scheme, arrays=True)
    both = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= scheme.percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def _ahead(code: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each member outside the largest component (`code`) the later members of other components, and all of the largest.

    In a group of two blocks only members of different blocks meet.
    """
    big = np.bincount(code).argmax()
    mixed = block.min() != block.max()
    for k in np.flatnonzero(code != big):
        other = code == big
        other[k + 1 :] |= code[k + 1 :] != code[k]
        if mixed:
            other &= block != block[k]
        yield k, np.flatnonzero(other)


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """`rows` (group, rep, comp, top, major, minor) sent to the pairs (p, q) of blocks of their group that they take part in.

    Members of the group's largest component `top` have the first `major` blocks and need not meet each other: they are
    sent to the `minor` other blocks only. The others meet all blocks.
    """
    of_top = F.col("comp").eqNullSafe(F.col("top"))
    deal = F.xxhash64("rep")
    rows = rows.withColumn("block", F.when(of_top, F.pmod(deal, "major")).otherwise(F.col("major") + F.pmod(deal, "minor")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(of_top, F.col("major")).otherwise(F.lit(0)), F.col("major") + F.col("minor") - 1)))
    return rows.select(group, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "rep", "comp", "block")


def _blocks(load: Column) -> Column:
    return F.ceil(load).cast("int")


def candidates(members: DataFrame, comps: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) within the signature distance that join what is near in the buckets, across components.

    Each member that has such a partner is in a link, and members that are near each other are connected by links, but
    only as many links as a spanning tree needs and one for each member are given: their number follows the members',
    not the pairs'. Buckets with the same members count once, and those of two members not at all: their pair is the one
    with the head. A bucket is cut into blocks of about BLOCK members; each pair of blocks is one group, compared in
    numpy, so that no task holds a large bucket; two blocks of the bucket's largest component need not meet.
    """
    rows = members.join(comps, members.rep == comps.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    buckets = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64(F.lit("s"), "rep").cast("decimal(38,0)")).alias("s")).where("lo < hi and n > 2")
    buckets = checkpointed(buckets.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n"))
    tops = rows.join(buckets.where(F.col("n") > BLOCK), "key").groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("t"))
    first = F.coalesce(F.col("t.count"), F.lit(0))
    buckets = buckets.join(tops, "key", "left").select("key", F.col("t.comp").alias("top"), _blocks(first / BLOCK).alias("major"), _blocks((F.col("n") - first) / BLOCK).alias("minor"))
    rows = _dealt(rows.join(buckets, "key"), "key").join(reps.select("rep", "sig"), "rep")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(-1, scheme.values)
        rep, found = pdf["rep"].to_numpy(), []
        label = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
        seen = np.zeros(len(pdf), bool)
        for k, other in _ahead(label.copy(), pdf["block"].to_numpy()):
            near = other[(sig[other] != sig[k]).sum(axis=1) <= scheme.distance]
            if not len(near):
                continue
            firsts = near[np.unique(label[near], return_index=True)[1]]
            ends = np.union1d(firsts[label[firsts] != label[k]], near[~seen[near]])
            if not len(ends) and not seen[k]:
                ends = near[:1]
            found.append(np.column_stack((np.full(len(ends), rep[k]), rep[ends])))
            seen[near] = seen[k] = True
            label[np.isin(label, label[near])] = label[k]
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("key", "p", "q").applyInPandas(compare, "a long, b long").distinct()


def settled(near: DataFrame, links: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Confirmed links (a, b) across components among the members of the candidate links `near`.

    The candidates' own components (with those that are known) are groups; a group is cut into blocks of about BLOCK
    members or BLOCK_SHINGLES shingles (those of its largest component apart, which need not meet each other), and each
    pair of blocks compares all pairs that are within the signature distance and not yet connected, on full sets, where
    they are. A task gives a spanning tree of the links that it finds.
    """
    groups = components(links.unionByName(near)).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    ids = checkpointed(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    known = comps.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    rows = ids.join(groups, "rep").join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(classes.select("rep", "sig", "n_shingles"), "rep")
    rows = checkpointed(rows)
    load = lambda n, s: F.greatest(n / BLOCK, s / BLOCK_SHINGLES)
    sizes = rows.groupBy("group", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).withColumn("x", load(F.col("n"), F.col("s")))
    sizes = sizes.groupBy("group").agg(F.max(F.struct("x", "comp", "n", "s")).alias("t"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("comps")).where("comps > 1")
    small = load(F.col("n"), F.col("s")) <= 1
    sizes = sizes.select(
        "group",
        F.when(~small, F.col("t.comp")).alias("top"),
        F.when(small, 0).otherwise(_blocks(F.col("t.x"))).alias("major"),
        F.when(small, 1).otherwise(_blocks(load(F.col("n") - F.col("t.n"), F.col("s") - F.col("t.s")))).alias("minor"),
    )
    dealt = _dealt(rows.join(sizes, "group"), "group").join(rows.select("rep", "sig"), "rep").join(_full_sets(ids, docs, scheme), "rep")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(-1, scheme.values)
        rep, found = pdf["rep"].to_numpy(), []
        label = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
        size = np.asarray([len(x) // 8 for x in pdf["shingles"]], np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(pdf.pop("shingles")), np.uint64)
        values = np.unique(flat)
        column = np.empty(len(flat), np.int32)
        for at in range(0, len(flat), 1 << 16):
            column[at : at + (1 << 16)] = np.searchsorted(values, flat[at : at + (1 << 16)])
        mark = np.zeros(len(values), np.int32)
        del flat, values
        for k, other in _ahead(label.copy(), pdf["block"].to_numpy()):
            other = other[(label[other] != label[k]) & (100 * np.minimum(size[other], size[k]) >= scheme.percent * np.maximum(size[other], size[k]))]
            other = other[(sig[other] != sig[k]).sum(axis=1) <= scheme.distance]
            if not len(other):
                continue
            own = column[start[k] : start[k] + size[k]]
            mark[own] = 1
            common = np.empty(len(other), np.int64)
            for at in range(0, len(other), 256):
                part = other[at : at + 256]
                ends = np.cumsum(size[part])
                place = np.arange(ends[-1]) + np.repeat(start[part] - (ends - size[part]), size[part])
                common[at : at + 256] = np.add.reduceat(mark[column[place]], ends - size[part])
            mark[own] = 0
            linked = other[100 * common >= scheme.percent * (size[k] + size[other] - common)]
            firsts = linked[np.unique(label[linked], return_index=True)[1]]
            found.append(np.column_stack((np.full(len(firsts), rep[k]), rep[firsts])))
            label[np.isin(label, label[linked])] = label[k]
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("group", "p", "q").applyInPandas(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs`.

    1. Equal sets become one class, represented by the smallest id, so that copies cost one signature join.
    2. The chunks' keys are buckets. Each bucket's smallest member is paired with the others: as many pairs as members.
    3. Pairs within the signature distance are confirmed on full sets; links make components.
    4. Buckets that still hold more than one component give groups of members that are near across components; all
       pairs of a group are compared on full sets where they are, and only a spanning tree of links leaves a task.

    So every pair within the signature distance is confirmed, or known to be of one component. Links hold between ids: a
    repeated id is one node. Null and empty texts have no shingles and stay alone. Rows without an id are linked by equal
    sets only: their component is that class's smallest id, or null if the class has none, and then they are kept.
    """
    docs = docs.select("doc_id", "text")
    rows = checkpointed(signed(docs, scheme))
    classes = checkpointed(rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")))
    reps = classes.where("rep is not null").select("rep", "sig")
    keyed = chunk_keys(reps, scheme)
    shared = keyed.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).where("head < tail").select("key", "head")
    members = checkpointed(keyed.join(shared, "key"))
    star = members.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    links = checkpointed(confirmed(within_distance(star, classes, scheme), docs, scheme))
    comps = checkpointed(components(links))
    near = checkpointed(candidates(members.select("key", "rep"), comps, reps, scheme))
    comps = checkpointed(components(links.unionByName(settled(near, links, comps, classes, docs, scheme))))
    named = classes.join(comps, classes.rep == comps.node, "left").select(F.col("set_id").alias("_set"), F.coalesce("component", "rep").alias("_component"))
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return rows.join(named, rows.set_id == named._set, "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = None
