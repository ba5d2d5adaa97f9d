"""N-gram Jaccard join with a token-group matrix.

A document's set holds the distinct shingles of its words. Two documents link when their sets' Jaccard
similarity reaches the threshold; the result is each document's component under links.

1. Documents with equal sets (two hashes of 64 bits) form a class; one set stands for it.
2. Tokens are ordered from rare to frequent: those of one text only, told by a filter, then the others by a
   sketch of their counts. Two linked sets must share a
   token among their first n - ceil(t * n) + 1, whatever the order, so sets without such a shared token are
   done. Frequent tokens come last: a line that a third of all documents share brings no candidates.
3. Sets that are joined by shared tokens form candidate families (connected components). Two sets that share only
   tokens of few sets are joined where their sizes, and the shared tokens' number and last places, leave room for the
   overlap that a link needs, so chance tokens do not chain families in a large corpus. A token of many sets joins those
   of like size by a star, so the number of rows stays linear. A family of many tokens is dealt over pairs of blocks.
4. Within a block pair, similar sets are put into groups, and the token-group matrix holds each group's token
   union. A query's overlap with a group's union bounds its overlap with every member; only groups whose
   bound reaches the threshold are opened and compared exactly. A query that already is in one component
   with all members of a group is not compared again.

Edge cases: null text and text without words have an empty set and link with nothing, not even each other, also
where a whole partition is such; a text of fewer words than a shingle has one shingle, its whole sequence; a text of
any length is one set, held by one task; rows that share a doc_id are judged each by its text; repeated rows link as
equal sets; null doc_id takes part as the smallest id and is returned as null; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import components
from larkspur.llm.filters import passes, small_filter
from larkspur.llm.kernels import mix, shingles, slices, text_bytes, words
from larkspur.llm.scratch import small_batches, written

#: Counters of the frequency sketch; one shingle counts in one of them.
SKETCH_BITS = 20
SKETCH_PART = 1 << 14
#: Bits of a hash by which tokens are told apart when they are counted, and the upper ones that name a bucket.
COUNT_BITS, BUCKET_BITS = 52, 12
#: Tokens that a task packs at a time.
PACKED_TOKENS = 500_000
#: Tokens of the sets of one block of a family.
BLOCK_TOKENS = 500_000
GROUP = 64
#: Cells of any matrix of tokens and groups, tokens and sets, or sets and groups.
CELLS = 3_000_000
#: Sets that may hold a token whose pairs are looked at one by one; a token of more joins its sets by a star.
MOST_PAIRED = 32
#: Parts into which the sets of one token are dealt before they meet at its hub.
HUB_PARTS = 32
NULL_ID = -(1 << 63)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a batch."""
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in slices(offsets):
        h, bounds = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
        for i, s in enumerate(shingles(h, bounds, size)):
            yield lo + i, s


def _short(h: np.ndarray) -> np.ndarray:
    """The bits of a hash by which tokens are counted, spread for the filter."""
    return mix(h >> np.uint64(64 - COUNT_BITS))


class Order:
    """Tokens from rare to frequent: those of one document only, then by the sketch."""

    def __init__(self, sketch: np.ndarray, shared: np.ndarray):
        self.sketch, self.shared = sketch, shared

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.lexsort((s, self.sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], passes(self.shared, _short(s))))


def token_order(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What Order needs: a sketch of how many documents hold a token, and a filter of those that several hold.

    Both only order the tokens, so counting by COUNT_BITS of a hash, and a filter that errs, cost time and nothing
    else. A task sends each of its tokens once, packed by bucket.
    """
    # Copies of a text would make all its tokens look shared: count one of each.
    firsts = docs.groupBy(F.xxhash64("text").alias("t")).agg(F.min("id").alias("id"))
    firsts = written(firsts.select(F.xxhash64("id").alias("key")), "firsts")  # the filter reads its keys twice
    sent = docs.sparkSession.sparkContext.broadcast(small_filter(firsts, "key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        seen: list[np.ndarray] = []
        held = 0

        def pack() -> pa.RecordBatch:
            h = np.sort(np.concatenate(seen)) >> np.uint64(64 - COUNT_BITS)
            seen.clear()
            first = np.concatenate([[True], h[1:] != h[:-1]])
            twice = np.unique(h[~first])
            h = h[first]
            edges = np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << np.uint64(COUNT_BITS - BUCKET_BITS)
            raw, again = h.view(np.uint8).reshape(-1, 8)[:, :5], twice.view(np.uint8).reshape(-1, 8)[:, :5]
            a, b = np.searchsorted(h, edges), np.searchsorted(twice, edges)
            some = np.flatnonzero(np.diff(a) > 0)
            arrays = [pa.array(some.astype(np.int32)), pa.array([raw[a[k] : a[k + 1]].tobytes() for k in some], pa.binary()), pa.array([again[b[k] : b[k + 1]].tobytes() for k in some], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["bucket", "tokens", "twice"])

        for b in batches:
            b = b.filter(pa.array(passes(sent.value, b.column("key").to_numpy().view(np.uint64))))
            found = [s for _, s in _sets(b, size)]
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            if len(flat):
                total += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                seen.append(flat)
                held += len(flat)
                if held >= PACKED_TOKENS:
                    yield pack()
                    held = 0
        if seen:
            yield pack()
        parts = np.minimum(total, (1 << 31) - 1).astype(np.int32).reshape(-1, SKETCH_PART)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array((-1 - some).astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary()), pa.array([None] * len(some), pa.binary())], ["bucket", "tokens", "twice"])

    def unpack(raw: list[bytes], high: int) -> np.ndarray:
        five = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
        out = np.zeros((len(five), 8), np.uint8)
        out[:, :5] = five
        return out.view(np.uint64).ravel() | np.uint64(high >> 40 << 40)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, again, total = None, [], [], None

        def end() -> pa.RecordBatch:
            if bucket is None or bucket < 0:
                out = total.astype(np.int64).tobytes() if bucket is not None else b""
            else:
                h = np.sort(unpack(held, bucket << (COUNT_BITS - BUCKET_BITS)))
                both = np.concatenate([h[1:][h[1:] == h[:-1]], unpack(again, bucket << (COUNT_BITS - BUCKET_BITS))])
                out = np.unique(both).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([out], pa.binary())], ["bucket", "content"])

        for b in batches:
            for k, tokens, twice in zip(b.column("bucket").to_pylist(), b.column("tokens").to_pylist(), b.column("twice").to_pylist()):
                if k != bucket:
                    if bucket is not None:
                        yield end()
                    bucket, held, again, total = k, [], [], np.zeros(SKETCH_PART, np.int64)
                if k < 0:
                    total += np.frombuffer(tokens, np.int32)
                else:
                    held.append(tokens)
                    again.append(twice)
        if bucket is not None:
            yield end()

    counted = docs.select("text", F.xxhash64("id").alias("key")).mapInArrow(count, "bucket int, tokens binary, twice binary")
    counted = written(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "bucket int, content binary"), "tokens")
    sketch = np.zeros((1 << SKETCH_BITS) // SKETCH_PART * SKETCH_PART, np.int64).reshape(-1, SKETCH_PART)
    for row in counted.where("bucket < 0").collect():  # the sketch, of fixed size
        sketch[-1 - row["bucket"]] = np.frombuffer(row["content"], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("content").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(mix(np.frombuffer(x, np.uint64)).view(np.int64))], ["token"])

    shared = counted.where("bucket >= 0").select("content").mapInArrow(spread, "token long")
    return np.minimum(sketch.ravel(), (1 << 31) - 1).astype(np.int32), small_filter(shared, "token")


def _first_hash(s: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return np.add.reduce(mix(s + np.uint64(1)))


def _second_hash(s: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return np.add.reduce(mix(s ^ np.uint64(0x5BD1E995A5A5A5A5)))


def summaries(docs: DataFrame, size: int, least: int) -> DataFrame:
    """id, n (set size), s1 and s2 (hashes of the set), prefix (its rarest tokens) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(token_order(docs, size))  # two arrays of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*sent.value)
        for b in batches:
            n, s1, s2, prefixes = [], [], [], []
            for _, s in _sets(b, size):
                n.append(len(s))
                s1.append(_first_hash(s))
                s2.append(_second_hash(s))
                k = len(s) - -(-least * len(s) // 100) + 1 if len(s) else 0
                prefixes.append(s[order(s)[:k]].view(np.int64))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, prefixes)]).astype(np.int32), pa.array(flat))
            arrays = [b.column("id"), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "s1", "s2", "prefix"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, s1 long, s2 long, prefix array<long>")


#: What tells classes of equal sets apart; the smallest node of a component has its smallest id.
NODE = "struct<id: long, s1: long, s2: long>"


def _shared_tokens(sets: DataFrame) -> DataFrame:
    """token, node, n (set size), place (from 1) for the prefix tokens that two sets may share."""
    counted = sets.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    several = written(counted.where("times > 1").select("token"), "several")  # the filter reads its keys twice
    sent = sets.sparkSession.sparkContext.broadcast(small_filter(several, "token"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("prefix")
            token = lists.flatten().to_numpy()
            long = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(b.num_rows), long)
            place = np.arange(len(token)) - np.repeat(np.cumsum(long) - long, long) + 1
            ok = passes(sent.value, token.view(np.uint64))
            own = pa.array(owner[ok])
            yield pa.RecordBatch.from_arrays([pa.array(token[ok]), b.column("node").take(own), b.column("n").take(own), pa.array(place[ok])], ["token", "node", "n", "place"])

    return sets.select("node", "n", "prefix").mapInArrow(keep, f"token long, node {NODE}, n long, place long")


def _close_pairs(tokens: DataFrame, least: int) -> DataFrame:
    """u, v of the sets that share tokens and may link, as far as the tokens given tell.

    Where these are all the tokens that two prefixes share, the overlap is at most their number and what follows the
    last of them in either set.
    """
    held = tokens.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "node", "place"))).alias("held"))  # MOST_PAIRED at most
    one = held.select("held", F.posexplode("held").alias("k", "a"))
    pairs = one.select("a", F.explode(F.slice("held", F.col("k") + 2, MOST_PAIRED)).alias("b")).where(100 * F.col("a.n") >= least * F.col("b.n"))
    met = pairs.groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv"))
    met = met.agg(F.count(F.lit(1)).alias("shared"), F.max("a.place").alias("i"), F.max("b.place").alias("j"))
    most = F.col("shared") + F.least(F.col("nu") - F.col("i"), F.col("nv") - F.col("j"))
    return met.where((100 + least) * most >= least * (F.col("nu") + F.col("nv"))).select("u", "v")


def _stars(tokens: DataFrame, least: int) -> DataFrame:
    """u, v that join the sets of each token, as far as their sizes may link.

    Sizes that may link are in the same class of sizes or in neighbouring ones, so each set goes to two. The sets of a
    class meet at the least of their part, and the parts at the least of all, so a token that many sets share is dealt
    over tasks.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / least))) if least < 100 else F.col("n")
    tokens = tokens.select("token", "node", F.explode(F.array(level, level + 1)).alias("level"), F.pmod(F.xxhash64("node"), F.lit(HUB_PARTS)).alias("part"))
    parts = tokens.groupBy("token", "level", "part").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
    edges = tokens.join(parts.where("hub != last").select("token", "level", "part", "hub"), ["token", "level", "part"]).where("node != hub")
    tops = parts.groupBy("token", "level").agg(F.min("hub").alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    above = parts.join(tops.select("token", "level", "top"), ["token", "level"]).where("hub != top")
    return edges.select(F.col("node").alias("u"), F.col("hub").alias("v")).unionByName(above.select(F.col("hub").alias("u"), F.col("top").alias("v")))


def families(sets: DataFrame, least: int) -> DataFrame:
    """node, family of every set that may link with another.

    Two sets that share a prefix token of many sets meet at its star; all other shared tokens of theirs are of few sets,
    so what these tell is whole.
    """
    tokens = written(_shared_tokens(sets), "shared_tokens")
    times = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    tokens = tokens.join(times, "token")
    edges = _close_pairs(tokens.where(F.col("times") <= MOST_PAIRED), least).unionByName(_stars(tokens.where(F.col("times") > MOST_PAIRED), least))
    return components(edges).select("node", F.col("root").alias("family"))


class Labels:
    """Components among m items; the smallest index is the label."""

    def __init__(self, m: int):
        self.of = np.arange(m)
        self.edges: list[tuple[int, int]] = []

    def merge(self, items: np.ndarray) -> None:
        found = np.unique(self.of[items])
        if len(found) > 1:
            self.edges += [(int(found[0]), int(x)) for x in found[1:]]
            self.of[np.isin(self.of, found)] = found[0]


def _rows(matrix: np.ndarray, tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """For each set in `which`, the sum of the matrix rows of its tokens."""
    out = np.zeros((len(which), matrix.shape[1]), np.int32)
    step = max(1, CELLS // 4 // max(1, matrix.shape[1]))
    some = which[counts[which] > 0]
    place = np.flatnonzero(counts[which] > 0)
    ends = np.cumsum(counts[some])
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        k = counts[some[lo:hi]]
        first = np.cumsum(k) - k
        at = np.repeat(starts[some[lo:hi]] - first, k) + np.arange(k.sum())
        out[place[lo:hi]] = np.add.reduceat(matrix[tokens[at]], first, axis=0, dtype=np.int32)
        lo = hi
    return out


def linked(sets: list[np.ndarray], side: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among sets; where both sides 0 and 1 occur, among pairs across them only.

    No matrix has more than CELLS cells: groups are bounded some at a time, and opened some members at a time.
    """
    m = len(sets)
    labels = Labels(m)
    if m < 2:
        return []
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), n)
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    del flat
    common = times[inverse] > 1  # a token of one set only adds to no overlap
    renamed = (np.cumsum(times > 1) - 1).astype(np.int32)
    tokens, owner = renamed[inverse[common]], owner[common]
    vocabulary = int((times > 1).sum())
    del inverse, times, common, renamed
    counts = np.bincount(owner, minlength=m)
    starts = np.cumsum(counts) - counts
    # Similar sets get neighbouring places: by the smallest of the mixed common tokens, then by size.
    least_token = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least_token, owner, mix(tokens.astype(np.uint64) + np.uint64(1)))
    cross = bool(side.any())
    order = np.lexsort((n, least_token, side))
    members = order[side[order] == 0] if cross else order
    groups = [members[i : i + GROUP] for i in range(0, len(members), GROUP)]
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    # Families of near copies share a small vocabulary: their sets then fit a dense matrix.
    dense = None
    if m * vocabulary <= CELLS:
        dense = np.zeros((m, vocabulary), np.float32)
        dense[owner, tokens] = 1

    def tokens_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of some sets one after another, and the number of the set each belongs to."""
        k = counts[own]
        first = np.cumsum(k) - k
        return tokens[np.repeat(starts[own] - first, k) + np.arange(k.sum())], np.repeat(np.arange(len(own)), k)

    def overlap(matrix: np.ndarray, which: np.ndarray) -> np.ndarray:
        if dense is None:
            return _rows(matrix, tokens, starts, counts, which)
        wide = matrix.astype(np.float32)
        step = max(1, CELLS // max(1, vocabulary))
        parts = [np.rint(dense[which[i : i + step]] @ wide).astype(np.int32) for i in range(0, len(which), step)]
        return np.concatenate(parts) if parts else np.zeros((0, matrix.shape[1]), np.int32)

    asking = np.flatnonzero(side == 1) if cross else np.arange(m)
    size = n[asking][:, None]
    width = int(np.clip(CELLS // max(vocabulary, len(asking), 1), 1, 256))
    for at in range(0, len(groups), width):
        some = groups[at : at + width]
        union = np.zeros((vocabulary, len(some)), np.int8)
        for g, own in enumerate(some):
            union[tokens_of(own)[0], g] = 1
        low = np.array([n[own].min() for own in some])
        high = np.array([n[own].max() for own in some])
        bound = overlap(union, asking)
        qualifies = (100 * bound.astype(np.int64) >= least * np.maximum(size, low)) & (100 * high >= least * size) & (100 * size >= least * low)
        del union, bound
        for g, own in enumerate(some):
            ask = asking[qualifies[:, g]]
            if not cross:
                ask = ask[place[ask] >= place[own[0]]]
            one = labels.of[own]
            if (one == one[0]).all():
                ask = ask[labels.of[ask] != one[0]]
            if not len(ask):
                continue
            few = max(1, CELLS // max(vocabulary, len(ask), 1))
            for i in range(0, len(own), few):
                part = own[i : i + few]
                matrix = np.zeros((vocabulary, len(part)), np.int8)
                matrix[tokens_of(part)] = 1
                both = overlap(matrix, ask).astype(np.int64)
                link = 100 * both >= least * (n[ask][:, None] + n[part] - both)
                for k, x in enumerate(part):
                    hit = ask[link[:, k]]
                    if len(hit):
                        labels.merge(np.append(hit, x))
    return labels.edges


def _compare(least: int):
    """Rows sorted by unit -> spanning edges; a unit is a pair of blocks of a family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        sides: list[int] = []
        sets: list[np.ndarray] = []
        unit = None

        def flush() -> pa.RecordBatch:
            edges = linked(sets, np.array(sides, np.int64), least) if sets else []
            u, v = (pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1))
            nodes = pa.concat_arrays(keys) if keys else None
            for x in (keys, sides, sets):
                x.clear()
            return pa.RecordBatch.from_arrays([nodes.take(u), nodes.take(v)], ["u", "v"]) if len(u) else None

        for b in batches:
            of = list(zip(b.column("family").to_pylist(), b.column("i").to_pylist(), b.column("j").to_pylist()))
            blocks = b.column("block").to_pylist()
            for r in range(b.num_rows):
                if unit != of[r]:
                    done = flush()
                    if done is not None:
                        yield done
                    unit = of[r]
                keys.append(b.column("node").slice(r, 1))
                sides.append(int(blocks[r] != of[r][1]))
                sets.append(np.frombuffer(b.column("tokens")[r].as_py(), np.uint64))
        done = flush()
        if done is not None:
            yield done

    return run


def link_components(docs: DataFrame, size: int = 3, least: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; sets link from `least` percent Jaccard similarity on."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    table = written(summaries(texts, size, least), "summaries")
    classes = table.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "n", "prefix")).alias("x"))
    classes = written(classes.select(F.struct("x.id", "s1", "s2").alias("node"), "x.n", "x.prefix"), "classes")
    member_of = families(classes, least)

    sizes = written(classes.select("node", "n").join(member_of, "node"), "members")
    blocks = sizes.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    members = sizes.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    sent = spark.sparkContext.broadcast(small_filter(sizes.select(F.xxhash64("node.id").alias("key")), "key"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(passes(sent.value, b.column("key").to_numpy().view(np.uint64))))
            found = [s for _, s in _sets(b, size)]
            s1, s2 = (pa.array(np.array([h(s) for s in found], np.uint64).view(np.int64)) for h in (_first_hash, _second_hash))
            yield pa.RecordBatch.from_arrays([b.column("id"), s1, s2, pa.array([s.tobytes() for s in found], pa.binary())], ["id", "s1", "s2", "tokens"])

    some = texts.select("id", "text", F.xxhash64("id").alias("key")).mapInArrow(tokens, "id long, s1 long, s2 long, tokens binary")
    dealt = members.drop("n").join(some.select(F.struct("id", "s1", "s2").alias("node"), "tokens"), "node")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = dealt.withColumn("pair", F.explode(pair)).select(F.xxhash64("family").alias("family"), "pair.i", "pair.j", "block", "node", "tokens")
    edges = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_compare(least), f"u {NODE}, v {NODE}")
    found = components(edges)

    roots = classes.select("node").join(found, "node", "left").select("node.s1", "node.s2", F.coalesce("root", "node")["id"].alias("root"))
    joined = table.drop("prefix").join(roots, ["s1", "s2"], "left")
    return joined.select(F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("root", "id"), F.lit(NULL_ID)).alias("component_id"))


def op10_jaccard_join(spark, sf_dir):
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same rows by plain set algebra; closure by recursion.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: hash(array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s), k AS MATERIALIZED (SELECT doc_id, n, t FROM n WHERE t IN (SELECT t FROM n GROUP BY t HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) ON a = doc_id"""
