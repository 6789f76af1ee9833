"""Exact Jaccard join of documents on word shingles by token-combination prefixes.

A document is its set of `width`-word shingles (64-bit hashes; a shorter text is one shingle of all its words).
Two documents link when den * intersection >= num * union, so of n tokens at most e = n - ceil(num n / den)
may be missing in the other. Tokens are put in one order for all: rare, frequent, very frequent, then by hash.
How frequent a token is comes from counts over all documents in a sketch of fixed size (BUCKETS), which is
all that is broadcast; the order and the classes need not be exact for the result to be. In a prefix of this order
rare tokens are indexed singly, frequent ones in pairs and very frequent ones in triples, formed within
subclasses by hash so that their number stays linear. The prefix is extended until the rare tokens plus, in
each subclass, the tokens beyond k - 1 number e + 1: no set of e missing tokens then avoids a shared entry.

Equal sets become one representative first. Entries with one representative drop out. In the others the least
id is a pivot that is paired with those of the rest whose sizes allow a link, then the least of those left in entries that still hold more than one
component. A pair goes on if sizes allow a link and so do parity bitmaps of the sets (bits of equal place cancel,
so differing bits never exceed differing tokens); pairs that are left are verified on the sets themselves. What the
pivots leave unjoined is compared whole, but for entries within another one: entries of at most COLD representatives give their pairs across
components; larger ones are first united with those that share most of their ids, so that a passage's documents are compared once
and not in each of its entries, and then the main component meets the rest, and the rest itself, two blocks at a time, by size and
bitmap. Two blocks with few possible pairs have all of them verified; of others a forest of possible pairs is verified
first, which joins most components, then every possible pair across what is left in their entries. So nothing is left out.

Tokens are hashes, so sets are exact but for collisions of 64-bit values. Null and empty texts have no shingles, no
links and n_shingles 0. A null doc_id is a document of its own for which component_id is null. Repeated rows of
one doc_id are returned each; they are one document, which links where any of its texts does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Hasher, Scratch, kept, mixed, pieces, small_batches, utf8, words
from tidemark.llm.components import components

BUCKETS_BITS, COLD, BLOCK, SEEN = 20, 32, 4096, 64
#: Possible pairs of two blocks, times their rows, up to which all are verified at once.
FEW = 4
#: Times the mean count of a bucket, plus the second number, above which tokens are taken in pairs and in triples.
FREQUENT, VERY_FREQUENT = (2, 64), (8, 2048)
_PLACE = mixed(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)
#: Bits of the filter of document ids whose sets are needed: 32 for each id, within these powers of two. A full filter only lets more through.
_FILTER_BITS = (20, 28)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, one text after the other, and where each text's begin."""
    start, end, row = words(data, off)
    one = Hasher(data)(start, end)
    n_rows, n = len(off) - 1, np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    k = max(1, len(one) - width + 1)
    h = np.zeros(k if len(one) else 0, np.uint64)
    for j in range(width if len(one) >= width else 0):
        h += one[j : j + k] * _PLACE[j]
    ok = row[: len(h)] == row[np.minimum(np.arange(len(h)) + width - 1, len(row) - 1)] if len(one) >= width else np.zeros(len(h), bool)
    hashes, rows = [mixed(h[ok])], [row[: len(h)][ok]]
    for r in np.flatnonzero((n > 0) & (n < width)):
        own = one[first[r] : first[r + 1]]
        hashes.append(mixed(np.array([(own * _PLACE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))])))
        rows.append(np.array([r]))
    x, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    x, r = x[new], r[new]
    return x, np.searchsorted(r, np.arange(n_rows + 1))


def _digest(x: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set."""
    sums = []
    for salt in (3, 5):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(x * np.uint64(salt) + np.uint64(salt << 40)))])
        sums.append(mixed(total[at[1:]] - total[at[:-1]]).view(np.int64))
    return sums


def parities(x: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bitmap for each set, of a power of two of at least two bits a token (64 at least): the parity of the tokens at each place."""
    n = np.diff(at)
    size = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(1, 2 * n))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(begin[:-1], n) + (x & (np.repeat(size, n) - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(begin[-1])) & 1).astype(np.uint8)).tobytes()
    return [packed[i:j] for i, j in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist(), strict=True)]


def _differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Places where two parity bitmaps differ, pair by pair; the longer one is folded to the other's size first."""
    size = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(size), np.int64)
    for la, lb in np.unique(size, axis=0).tolist():
        at, w = np.flatnonzero((size == (la, lb)).all(1)), min(la, lb)
        u, v = (np.frombuffer(b"".join([z[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1, w) for z in (a, b))
        out[at] = np.bitwise_count(np.bitwise_xor.reduce(u, 1) ^ np.bitwise_xor.reduce(v, 1)).sum(1, dtype=np.int64)
    return out


def summaries(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n, two digests, a parity bitmap and the index entries of each document's set."""
    classes = docs.sparkSession.sparkContext.broadcast(np.packbits(np.unpackbits(sketch(docs, width)[:, None], axis=1, count=8)[:, 6:].ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = np.unpackbits(classes.value).reshape(-1, 2)
        kinds = two[:, 0] * 2 + two[:, 1]
        for b in pieces(batches):
            x, at = shingle_sets(*utf8(b), width)
            sig, row = entries(x, at, kinds, num, den)
            order = np.argsort(row, kind="stable")
            of = pa.array(np.searchsorted(row[order], np.arange(len(at))), pa.int32())
            sigs = pa.ListArray.from_arrays(of, pa.array(sig[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), *map(pa.array, _digest(x, at)), pa.array(parities(x, at), pa.binary()), sigs], ["doc_id", "n", "d1", "d2", "bits", "sigs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bits binary, sigs array<long>")


def _sums(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], parts: int = 16) -> np.ndarray:
    """The arrays of equal size that run makes of each partition, merged on the executors in slices; only the merged one comes to the driver."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in run(batches):
            cut = np.array_split(whole, parts)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary()), pa.array([whole.dtype.str] * parts)], ["part", "bytes", "kind"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data, kind in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                own = np.frombuffer(data.as_buffer(), kind)
                have[part] = merge(have[part], own) if part in have else own.copy()
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([x.tobytes() for x in have.values()], pa.binary()), pa.array([x.dtype.str for x in have.values()])], ["part", "bytes", "kind"])

    schema = "part int, bytes binary, kind string"
    rows = df.mapInArrow(sliced, schema).repartition(parts, "part").mapInArrow(merged, schema).collect()
    return np.concatenate([np.frombuffer(r.bytes, r.kind) for r in sorted(rows, key=lambda r: r.part)] or [np.zeros(0, np.uint8)])


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Class (0, 1, 2) of each bucket of hashes, from the number of documents with a token in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros(1 << BUCKETS_BITS, np.uint64)
        for b in pieces(batches):
            x, _ = shingle_sets(*utf8(b), width)
            total += np.bincount((x >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint64)
        yield total

    total = _sums(docs.select("text"), count, np.add)
    total = total if len(total) else np.zeros(1 << BUCKETS_BITS, np.uint64)
    mean = int(total.sum()) / len(total)
    return (total > FREQUENT[0] * mean + FREQUENT[1]).astype(np.uint8) + (total > VERY_FREQUENT[0] * mean + VERY_FREQUENT[1])


def _missing(n: int, num: int, den: int) -> int:
    """How many of n tokens may be missing in a linked set."""
    return n - -(-num * n // den)


def _subclasses(e: int) -> int:
    return 1 << max(0, ((e + 1) // 3).bit_length() - 1)


def entries(x: np.ndarray, at: np.ndarray, classes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries (64-bit) and the row of each."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    kind = classes[(x >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)]
    order = np.lexsort((x, kind, row))
    x, kind = x[order], kind[order]
    need = n - -(-num * n // den) + 1
    most = n * den // num
    alone = most - -(-num * most // den) == 0  # such sets link with equal sets only
    rare = np.bincount(row, kind == 0, len(n)).astype(np.int64)
    place = np.arange(len(x)) - at[:-1][row]
    single = (kind == 0) & (place < need[row]) & ~alone[row]
    out, rows = [x[single]], [row[single]]
    for r in np.flatnonzero((rare < need) & ~alone):
        tokens = x[at[r] + rare[r] : at[r + 1]].tolist()
        kinds = (kind[at[r] + rare[r] : at[r + 1]] + 1).tolist()
        g, last = _subclasses(int(need[r]) - 1), _subclasses(_missing(int(most[r]), num, den))
        own: list[int] = []
        while g <= last:
            have, groups = int(rare[r]), {}
            for t, k in zip(tokens, kinds, strict=True):
                if have >= need[r]:
                    break
                group = groups.setdefault((k, t % g), [])
                have += len(group) >= k - 1
                salt = g * 0x9E3779B97F4A7C15 + k
                if k == 2:
                    own += [_combined(salt, u, t) for u in group]
                else:
                    own += [_combined(salt, u, v, t) for i, v in enumerate(group) for u in group[:i]]
                group.append(t)
            g *= 2
        out.append(mixed(np.array(own, np.uint64)))
        rows.append(np.full(len(own), r))
    return np.concatenate(out), np.concatenate(rows)


def _combined(salt: int, *tokens: int) -> int:
    for t in sorted(tokens):
        salt = (salt ^ t) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        salt ^= salt >> 29
    return salt


def _like_sizes(a: str, b: str, num: int, den: int) -> Column:
    """Whether sets of these sizes may link; a null size may with any."""
    x, y = (F.col(c).cast("long") for c in (a, b))
    return F.coalesce((x * den >= y * num) & (y * den >= x * num), F.lit(True))


def marks(ids: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """Whether ids (not null) may be among those of the table (column id): true for all of these and for some others. For use in tasks."""
    power = int(np.clip((32 * ids.count()).bit_length(), *_FILTER_BITS))

    def place(x: pa.Array) -> np.ndarray:
        return (mixed(np.asarray(x).astype(np.int64).view(np.uint64)) >> np.uint64(64 - power)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen = np.zeros(1 << power, bool)
        for b in batches:
            seen[place(b.column(0))] = True
        yield np.packbits(seen)

    flat = _sums(ids.select("id"), mark, np.bitwise_or)
    marked = ids.sparkSession.sparkContext.broadcast(flat if len(flat) else np.zeros((1 << power) // 8, np.uint8))

    def maybe(x: pa.Array) -> np.ndarray:
        at = place(x)
        return marked.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1

    return maybe


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, n and the sorted set as bytes, of the documents whose id is among ids (column id), and of some others."""
    maybe = marks(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(iter([b.filter(pa.array(maybe(b.column(0))))])):
                x, at = shingle_sets(*utf8(p), width)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(np.diff(at), pa.int64()), pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "n", "tokens"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "id long, n long, tokens binary")


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return den * same >= num * (len(a) + len(b) - same)


def possible(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b whose sizes and bitmaps (id, n, bits) allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.asarray(b.column(2)) + np.asarray(b.column(3))
            most = total - 2 * -(-num * total // (num + den))  # tokens in one set only
            ok = pa.array(_differing(b.column(4).to_pylist(), b.column(5).to_pylist()) <= most)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in range(2)], ["a", "b"])

    left, right = (info.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")
    near = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(_like_sizes("na", "nb", num, den))
    return near.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            ok = [_linked(np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64), num, den) for u, v in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok, pa.bool_())) for i in range(2)], ["a", "b"])

    left, right = (sets.select(F.col("id").alias(k), F.col("tokens").alias(f"tokens{k}")) for k in "ab")
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "tokensa", "tokensb").mapInArrow(run, "a long, b long")


def _across(rows: list[tuple[int, int, int, int, bytes]], same_block: bool, num: int, den: int, most: float) -> tuple[list[tuple[int, int]], bool]:
    """Possible pairs of different components among rows of id, comp, block, n and bits, and whether these are all: if there are more than `most`, a spanning forest of them."""
    ids, comp, block, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    wide = sorted({len(r[4]) for r in rows})
    folded = {}  # for each bitmap size, the rows of that or a larger size, folded to it
    for w in wide:
        own = np.flatnonzero([len(r[4]) >= w for r in rows])
        m = np.empty((len(own), w), np.uint8)
        for i, r in enumerate(own):
            m[i] = np.bitwise_xor.reduce(np.frombuffer(rows[r][4], np.uint8).reshape(-1, w), 0)
        folded[w] = (own, m)
    whole, forest, joined = [], [], comp.copy()  # joined: the components if all pairs of the forest link
    for i, r in enumerate(rows):
        own, m = folded[len(r[4])]
        ok = (comp[own] != comp[i]) & (n[own] * den >= n[i] * num) & (n[i] * den >= n[own] * num) & (same_block | (block[own] != block[i]))
        ok &= (n[own] > n[i]) | (n[own] == n[i]) & (ids[own] < ids[i])  # each pair once, from its smaller set
        if len(whole) > most:
            ok &= joined[own] != joined[i]
        at = own[ok]
        if not at.size:
            continue
        total = n[at] + n[i]
        near = at[np.bitwise_count(m[ok] ^ m[np.searchsorted(own, i)]).sum(1, dtype=np.int64) <= total - 2 * -(-num * total // (num + den))]
        if len(whole) <= most:
            whole += [(int(ids[i]), int(ids[j])) for j in near]
        while (near := near[joined[near] != joined[i]]).size:
            forest.append((int(ids[i]), int(ids[near[0]])))
            joined[joined == joined[near[0]]] = joined[i]
    return (whole, True) if len(whole) <= most else (forest, False)


def _tiles(rest: DataFrame, info: DataFrame) -> DataFrame:
    """id, comp, n, bits, sig, block, i and j: each row of the entries (sig, id, comp) that hold several components, once for each pair of blocks (i, j) that it is in.

    An entry of BLOCK rows at most is one block. In larger ones blocks of the main component, the one with most rows, meet the blocks of the others only, so that an entry that is nearly all one component is compared in time proportional to its size.
    """
    # Windows of one shuffle and a list for each id, no joins of entries: so sizes and bitmaps are joined once an id and not once in each of its entries.
    entry = W.partitionBy("sig")
    counted = rest.select("sig", "id", "comp").repartition("sig").withColumn("c", F.count("*").over(W.partitionBy("sig", "comp")))
    several = counted.select("*", F.max_by("comp", F.struct("c", "comp")).over(entry).alias("main"), F.max("c").over(entry).alias("most"), F.count("*").over(entry).alias("m")).where("most < m")
    small = F.col("m") <= BLOCK
    others, mains = (F.when(small, n).otherwise(F.ceil(x / BLOCK)).cast("int") for n, x in ((1, F.col("m") - F.col("most")), (0, F.col("most"))))
    is_main = (F.col("comp") == F.col("main")) & ~small
    hashed = F.xxhash64("id")
    placed = several.withColumn("block", F.when(is_main, others + F.pmod(hashed, mains)).otherwise(F.pmod(hashed, others)).cast("int")).withColumn("meets", F.when(is_main, others).otherwise(others + mains))
    own = placed.groupBy("id").agg(F.min("comp").alias("comp"), F.collect_list(F.struct("sig", "block", "meets")).alias("at")).join(info, "id")
    tiles = F.flatten(F.transform("at", lambda x: F.transform(F.sequence(F.lit(0), x.meets - 1), lambda j: F.struct(x.sig.alias("sig"), x.block.alias("block"), F.least(x.block, j).alias("i"), F.greatest(x.block, j).alias("j")))))
    return own.select("id", "comp", "n", "bits", F.explode(tiles).alias("t")).select("id", "comp", "n", "bits", "t.*")


def _blocked(rest: DataFrame, info: DataFrame, num: int, den: int, most: float) -> DataFrame:
    """Possible pairs a, b across components in each entry (sig, id, comp), block by block, and `whole`: false for those of two blocks with more than `most` pairs a row, of which it has a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["id"], pdf["comp"], pdf["block"], pdf["n"], pdf["bits"], strict=True), key=lambda r: r[0])
        pairs, whole = _across(rows, bool(pdf["i"].iloc[0] == pdf["j"].iloc[0]), num, den, most * len(rows))
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64").assign(sig=pdf["sig"].iloc[0], whole=whole)

    return _tiles(rest, info).groupBy("sig", "i", "j").applyInPandas(run, "a long, b long, sig long, whole boolean")


def without(rows: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
    """rows (doc_id not null) less those that are equal in the columns `on`, doc_id among them, to a row of some; only rows whose id may be among theirs are shuffled."""
    maybe = marks(some.select(F.col("doc_id").alias("id")))
    near = F.pandas_udf(lambda x: pd.Series(maybe(x.to_numpy())), "boolean")("doc_id")
    return rows.where(~near).unionByName(rows.where(near).join(some, on, "left_anti"))


def uncovered(rest: DataFrame) -> DataFrame:
    """rest (sig, id, m and others) less the entries all of whose ids are in another one, which has their pairs too.

    Each id has a largest entry. The least of these over an entry's ids is the one that may hold it; of entries that hold each other the largest stays.
    """
    rank = F.struct("m", "sig")
    own = rest.select("*", rank.alias("rank"), F.max(rank).over(W.partitionBy("id")).alias("top"))
    own = own.withColumn("by", F.min("top").over(W.partitionBy("sig"))).drop("top")
    # An id is once in an entry: of the ids of a row's other entry it is one if both stand in its own list of entries.
    own = own.withColumn("in", (F.col("by") > F.col("rank")) & F.array_contains(F.collect_set("sig").over(W.partitionBy("id")), F.col("by.sig")))
    # A window and no join with the entries that are held, as rows are many for an entry.
    return own.select(*rest.columns, F.bool_and("in").over(W.partitionBy("sig")).alias("held")).where("not held").drop("held")


def united(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """rest (sig, id, n, m, comp) with the entries that share most of their ids made one, which has the pairs of each, wherever that compares no more pairs than they do singly.

    Each id has a largest entry, and an entry goes to the one that is so for most of its ids. m becomes the number of rows, sig a new one where entries are united.
    """
    by, of = W.partitionBy("sig"), W.partitionBy("sig", "top")
    top = rest.withColumn("top", F.max(F.struct("m", "sig")).over(W.partitionBy("id"))["sig"]).repartition("sig").withColumn("c", F.count("*").over(of))
    goes = top.withColumn("into", F.max_by("top", F.struct("c", "top")).over(by)).withColumn("m", F.count("*").over(by))
    # An entry has m rows, so the sum of m over rows is that of the entries' squares.
    each = scratch.keep(goes.groupBy("into", "id").agg(F.min("n").alias("n"), F.min("comp").alias("comp"), F.sum("m").alias("pairs"), F.collect_set(F.struct("sig", "m")).alias("at")))
    fits = each.groupBy("into").agg(F.count("*").alias("all"), F.sum("pairs").alias("pairs")).where(F.col("all").cast("double") * F.col("all") <= F.col("pairs"))
    at = F.when(F.col("all").isNull(), F.col("at")).otherwise(F.array(F.struct(F.xxhash64("into").alias("sig"), F.col("all").alias("m"))))
    return each.drop("pairs").join(fits.drop("pairs"), "into", "left").select("id", "n", "comp", F.explode(at).alias("e")).select("e.sig", "id", "n", "e.m", "comp")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each document: the least doc_id reachable by links, itself included."""
    with Scratch(docs.sparkSession) as scratch, small_batches(docs.sparkSession):
        keep = scratch.keep
        with Scratch(docs.sparkSession) as first:
            whole = first.keep(summaries(docs, width, num, den))
            rows = keep(whole.drop("sigs", "bits"))
            known = rows.where("n > 0 and doc_id is not null")
            # Dealt by id once, as every join with it asks for.
            info = scratch.dealt(whole.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "n", "bits"), "id")
            same = known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep != last")
            copies = first.keep(known.join(same, ["n", "d1", "d2"]).where("doc_id != rep").select("doc_id", "n", "d1", "d2", "rep").distinct())
            links = keep(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
            # An id whose texts differ in size has no one size, so its pairs are all made.
            sizes = first.keep(known.groupBy("doc_id").agg(F.min("n").alias("low"), F.max("n").alias("high")).where("low != high"))
            own = without(whole.where("doc_id is not null").drop("bits"), copies.drop("rep"), ["doc_id", "n", "d1", "d2"]).join(sizes, "doc_id", "left")
            own = own.select(F.col("doc_id").alias("id"), F.when(F.col("low").isNull(), F.col("n")).cast("int").alias("n"), F.explode("sigs").alias("sig"))
            # A window and no join with a grouping: so the entries, the largest table by far, are shuffled once.
            by = W.partitionBy("sig")
            heads = own.select("sig", "id", "n", F.min("id").over(by).alias("pivot"), F.min_by("n", "id").over(by).alias("np"), F.max("id").over(by).alias("last"), F.count("*").over(by).alias("m"))
            shared = keep(heads.where("pivot != last").drop("last"))

        comp = None  # the components of links, until there are new ones

        def link(pairs: DataFrame) -> None:
            """Adds the links a, b among the pairs."""
            nonlocal links, comp
            near = keep(possible(pairs, info, num, den))
            if near.isEmpty():
                return
            sets = keep(sets_of(docs, near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), width))
            found = keep(verified(near, sets, num, den))
            if not found.isEmpty():
                links, comp = keep(links.union(found)), None

        def labels() -> DataFrame:
            nonlocal comp
            comp = components(links, scratch) if comp is None else comp
            return comp

        def labelled(df: DataFrame) -> DataFrame:
            """sig, id, n, m and the component so far of each id."""
            return df.select("sig", "id", "n", "m").join(labels(), "id", "left").select("sig", "id", "n", "m", F.coalesce("comp", "id").alias("comp"))

        # Sizes go with the entries, so that pairs whose sizes rule a link out are never made.
        link(shared.where((F.col("id") != F.col("pivot")) & _like_sizes("n", "np", num, den)).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
        # Entries of two are done. In the others a pivot has met all others and is left out from here on.
        rest = keep(labelled(shared.where("m > 2 and id != pivot")))
        pivots = {"pivot": F.min("id"), "np": F.min_by("n", "id"), "of": F.min_by("comp", "id"), "low": F.min("comp"), "high": F.max("comp")}
        rest = keep(rest.select("*", *(x.over(by).alias(c) for c, x in pivots.items())).where("low != high and id != pivot").drop("low", "high"))
        if not rest.isEmpty():
            link(rest.where((F.col("comp") != F.col("of")) & _like_sizes("n", "np", num, den)).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
            rest = keep(labelled(keep(uncovered(rest.select("sig", "id", "n", "m")))))
            cold, hot = rest.where(F.col("m") <= COLD), keep(united(rest.where(F.col("m") > COLD), scratch))
            # A pair is made in the least entry that both have, as far as the first SEEN of each tell.
            cold = cold.withColumn("seen", F.slice(F.array_sort(F.collect_set("sig").over(W.partitionBy("id"))), 1, SEEN))
            left, right = (cold.select("sig", F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("comp").alias(f"comp{k}"), F.col("seen").alias(f"seen{k}")) for k in "ab")
            pairs = left.join(right, "sig").where(F.expr("a < b and compa != compb and coalesce(array_min(array_intersect(seena, seenb)) >= sig, true)") & _like_sizes("na", "nb", num, den)).select("a", "b")
            blocked = keep(_blocked(hot, info, num, den, FEW))
            link(pairs.union(blocked.select("a", "b")).distinct())
            more = keep(blocked.where("not whole").select("sig").distinct())
            if not more.isEmpty():
                link(_blocked(labelled(hot.join(more, "sig", "left_semi")), info, num, den, math.inf).select("a", "b").distinct())
        ids = labels().withColumnRenamed("id", "doc_id")
        return kept(rows.join(ids, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that are the least doc_id of their component, all rows of it. Rows without words or id stay."""
    found = near_duplicates(docs, width, num, den)
    drop = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti")
