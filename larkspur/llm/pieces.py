"""SentencePiece encoding and decoding with sampled segmentations, without replacement.

A text's segmentations form a lattice over its words. Each has a probability, proportional to the product of
its pieces' weights (a Zipf law over the vocabulary's order). Gumbel top-k gives every segmentation a perturbed
log probability and takes the k greatest, which samples k distinct segmentations without replacement. They are
found by A* search: a node is a set of segmentations with a common beginning, its priority the greatest
perturbed value inside, which is drawn without expanding the node (the greatest of a set of Gumbels is a
Gumbel of the set's mass, cut off at its parent's value). Popping a node expands it into its best segmentation
and the sets that branch off at each later word.

All random numbers come from the row key, so a row's samples depend neither on batches nor on its neighbours.

inclusion is the probability that a segmentation exceeds the (k + 1)-th perturbed value, as used to weight
samples drawn without replacement; it is 1 if a text has no more than k segmentations.

A text is cut into words, which keep the space before them, only where no piece of the vocabulary holds the two
characters at the cut, so the product over words is the whole lattice (of a stretch of over LONGEST_UNIT characters
without such a place, which no prose has, pieces across every LONGEST_UNIT-th character are left out). Characters
without a piece, and U+2581 itself, are encoded as bytes, so decoding is exact.

Edge cases: null or empty text gives one empty segmentation with log probability 0; an empty table gives no rows; texts
are handled some at a time, a long one as a whole; equal perturbed values have probability zero, and then the earlier
place counts; a text with fewer than k
segmentations gives all it has (of a word, what is left under a share of 1e-12 counts as nothing); null keys are seeded as 0; rows that share a key share their random numbers;
lone surrogates cannot occur in Spark strings; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import HashIndex, code_points, mix, per_character, slices, spans, sums, text_bytes
from larkspur.llm.scratch import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a word at most, and those from which on cuts within it are looked for.
LONGEST_UNIT, LONG_UNIT = 4096, 48
SLICE_BYTES = 3 << 18


def load_pieces(path: str = MODEL) -> dict:
    """pieces (text, with spaces, -> id and log weight), bytes (ids of the byte pieces), decode (id -> bytes)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-m.get_score(i), i))
    weight = {i: -float(np.log(r + 2)) for r, i in enumerate(ranked)}
    byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    decode = [b""] * n
    for i in plain:
        decode[i] = m.id_to_piece(i).replace(SPACE, " ").encode()
    for b, i in enumerate(byte_ids):
        decode[i] = bytes([b])
    return {"pieces": {m.id_to_piece(i).replace(SPACE, " "): (i, weight[i]) for i in plain}, "bytes": byte_ids, "byte_weight": -float(np.log(n + 2)), "decode": decode}


class Vocabulary:
    """Pieces and their beginnings by hash."""

    def __init__(self, model: dict):
        pieces = model["pieces"]
        beginnings = list({p[:k]: None for p in pieces for k in range(1, len(p) + 1)})
        ends = np.cumsum([0, *map(len, beginnings)]).astype(np.int64)
        self.index = HashIndex(spans(sums(code_points(beginnings)), ends[:-1], ends[1:]))
        known = [pieces.get(b, (-1, 0.0)) for b in beginnings]
        self.ids, self.weights = np.array([k[0] for k in known], np.int32), np.array([k[1] for k in known])
        self.byte_ids, self.byte_weight = model["bytes"], model["byte_weight"]
        self.longest = max(map(len, pieces), default=1)
        inner = {(ord(a) << 21) | ord(b) for p in pieces for a, b in zip(p, p[1:])}
        self.pairs = np.array(sorted(inner), np.int64)

    def joined(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether some piece holds a character right before another."""
        pair = (before.astype(np.int64) << 21) | after.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Piece ids, with the bytes of each character that has no piece (-1 less its code point)."""
        odd = ids < 0
        if not odd.any():
            return ids
        chars, which = np.unique(-1 - ids[odd], return_inverse=True)
        spelled = [np.array([self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")]) for c in chars.tolist()]
        size = np.ones(len(ids), np.int64)
        size[odd] = np.array([len(x) for x in spelled])[which]
        first = np.cumsum(size) - size
        out = np.repeat(ids, size)
        for k in range(int(size.max())):
            own = odd & (size > k)
            byte = np.array([x[k] if len(x) > k else 0 for x in spelled])
            out[first[own] + k] = byte[which[size[odd] > k]]
        return out


class Flat:
    """The lattices of some words side by side: edges in order of the node where they end.

    codes: the words' code points one after another; length: of each word.
    """

    def __init__(self, codes: np.ndarray, length: np.ndarray, vocabulary: Vocabulary):
        total = sums(codes)
        sizes = length + 1
        base = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(length), dtype=np.int32), length)
        end = np.repeat(np.cumsum(length, dtype=np.int32), length)
        inside = (np.arange(len(codes), dtype=np.int32) - (end - np.repeat(length.astype(np.int32), length))).astype(np.uint16)
        open_ = np.arange(len(codes), dtype=np.int32)
        parts = []
        for k in range(1, vocabulary.longest + 1):
            open_ = open_[open_ + k <= end[open_]]
            if not len(open_):
                break
            at = vocabulary.index.find(spans(total, open_, open_ + k))
            piece = (at >= 0) & (vocabulary.ids[at] >= 0)
            if k == 1:  # a character without a piece is spelled in bytes
                rest = open_[~piece]
                size = 1 + (codes[rest] >= 0x80) + (codes[rest] >= 0x800) + (codes[rest] >= 0x10000)
                parts.append((rest, inside[rest] + np.uint16(1), -1 - codes[rest].astype(np.int32), vocabulary.byte_weight * size))
            some = open_[piece]
            parts.append((some, inside[some] + np.uint16(k), vocabulary.ids[at[piece]], vocabulary.weights[at[piece]]))
            open_ = open_[at >= 0]
        start, level, ids, weight = (np.concatenate(x) for x in zip(*parts))
        # Nodes are the places between characters, one more than characters in each word.
        stop = start - inside[start] + word[start] + level
        start = start + word[start]
        order = np.argsort(stop, kind="stable")
        self.start, self.ids = start[order], ids[order]
        stop, level, weight = stop[order], level[order], weight[order]
        nodes = int(sizes.sum())
        mass = np.full(nodes, -np.inf)
        mass[base] = 0.0
        by_level = np.argsort(level, kind="stable")
        cut = np.searchsorted(level[by_level], np.arange(1, int(level.max()) + 2))
        for a, b in zip(cut[:-1], cut[1:]):
            e = by_level[a:b]
            if len(e):
                value = mass[self.start[e]] + weight[e]
                first = np.flatnonzero(np.concatenate([[True], stop[e[1:]] != stop[e[:-1]]]))
                top = np.maximum.reduceat(value, first)
                total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(first, len(e))))), first)
                mass[stop[e[first]]] = top + np.log(total)
        self.share = mass[self.start] + weight - mass[stop]  # log share of each edge among those that end with it
        # A node's shares add up to one: their running sums, shifted by the node's number, are one sorted list.
        p = np.exp(self.share)
        running = np.cumsum(p)
        first = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]]))
        counts = np.diff(np.append(first, len(stop)))
        self.first = np.zeros(nodes, np.int64)
        self.first[stop[first]] = first
        self.last = np.zeros(nodes, np.int64)
        self.last[stop[first]] = first + counts - 1
        self.limits = np.minimum(running - np.repeat(running[first] - p[first], counts), 1.0) + stop
        self.begin, self.end = base, base + sizes - 1


def uniform(seed: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seed and two counters only."""
    with np.errstate(over="ignore"):
        h = mix(seed + a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def draw(flat: Flat, unit: np.ndarray, order: np.ndarray, seed: np.ndarray, place: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segmentation of each word: its edges one after another, where each word's begin, its log probability.

    order: brings equal words together, so that their edges stay in cache.
    """
    n = len(unit)
    node, own, begin = flat.end[unit[order]], order, flat.begin[unit[order]]
    log_p, steps, path = np.zeros(n), np.zeros(n, np.int64), []
    step = 0
    while len(node):
        u = uniform(seed[own], place[own], salt * 4096 + step)
        e = np.clip(np.searchsorted(flat.limits, node + u), flat.first[node], flat.last[node])
        path.append((own, e))
        log_p[own] += flat.share[e]
        steps[own] += 1
        node = flat.start[e]
        more = node > begin
        node, own, begin = node[more], own[more], begin[more]
        step += 1
    starts = np.concatenate([[0], np.cumsum(steps)])
    edges = np.zeros(starts[-1], np.int64)
    for step, (own, e) in enumerate(path):
        edges[starts[own + 1] - 1 - step] = e
    return edges, starts, log_p


def other(flat: Flat, unit: int, taken: list[np.ndarray], u: np.ndarray) -> tuple[np.ndarray, float]:
    """A segmentation of a word drawn among those not taken, and its log probability among all."""
    node, begin, out, log_p, depth = int(flat.end[unit]), int(flat.begin[unit]), [], 0.0, 0
    live = [t[::-1] for t in taken]
    while node > begin:
        lo, hi = int(flat.first[node]), int(flat.last[node]) + 1
        p = np.exp(flat.share[lo:hi])
        for t in live:
            p[t[depth] - lo] -= np.exp(flat.share[t[depth:]].sum())
        p = np.maximum(p, 0)
        total = p.sum()
        e = lo + (int(np.searchsorted(np.cumsum(p), u[depth] * total, "right")) if total > 0 else int(np.argmax(p)))
        e = min(e, hi - 1)
        live = [t for t in live if t[depth] == e]
        out.append(e)
        log_p += float(flat.share[e])
        node = int(flat.start[e])
        depth += 1
    return np.array(out[::-1]), log_p


def branch(log_mass: np.ndarray, limit: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """The greatest perturbed value among a set of the given mass, cut off at `limit`."""
    with np.errstate(divide="ignore", over="ignore"):
        return log_mass - np.log(np.exp(log_mass - limit) - np.log(u))


def segments(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of what stands before each value in its stretch."""
    total = np.cumsum(values) - values
    counts = np.diff(edge)
    return total - np.repeat(total[np.minimum(edge[:-1], len(total) - 1)], counts) if len(values) else values


def off_values(before: np.ndarray, log_p: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Greatest perturbed value of what branches off at each word."""
    with np.errstate(divide="ignore"):
        mass = before + np.log(np.maximum(-np.expm1(log_p), 0))
    mass[log_p > -1e-12] = -np.inf
    return branch(mass, limit, u)


class Path:
    """A segmentation of one text: edges and pieces, where each word's begin, and values of what branches off."""

    __slots__ = ("edges", "starts", "ids", "places", "log_p", "before", "off", "value", "taken")

    def __init__(self, edges, starts, ids, places, log_p, before, off, value):
        self.edges, self.starts, self.ids, self.places = edges, starts, ids, places
        self.log_p, self.before, self.off, self.value = log_p, before, off, value
        self.taken: dict[int, list[np.ndarray]] = {}


def kind_of(c: str) -> int:
    """0 space, 1 part of a word, 2 other."""
    return 0 if c == " " else 1 if c.isalnum() or c == "_" else 2


def units(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts, each after a space; where words start and stop; each text's range of words."""
    codes = code_points([f" {t}" for t in texts if t])
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    kind = per_character(codes, kind_of, np.int8)
    n = len(codes)
    fresh = np.zeros(n + 1, bool)
    fresh[edge] = True
    fresh = fresh[:n]
    fresh[1:] |= kind[1:] != kind[:-1]
    # The last space before a word belongs to it: the word starts there.
    joins = np.flatnonzero(fresh[1:] & (kind[1:] == 1) & (kind[:-1] == 0)) + 1
    joins = joins[~np.isin(joins, edge)]
    fresh[joins] = False
    fresh[joins - 1] = True
    # A cut stays only where no piece crosses it; in long words cuts are made where none does.
    begins = np.zeros(n + 1, bool)
    begins[edge] = True
    cuts = np.flatnonzero(fresh)
    cuts = cuts[~begins[cuts]]
    fresh[cuts[vocabulary.joined(codes[cuts - 1], codes[cuts])]] = False
    starts = np.flatnonzero(fresh)
    length = np.diff(np.append(starts, n))
    long = np.flatnonzero(length > LONG_UNIT)
    if len(long):
        some = np.repeat(starts[long] + 1 - np.cumsum(length[long] - 1) + (length[long] - 1), length[long] - 1) + np.arange((length[long] - 1).sum())
        fresh[some[~vocabulary.joined(codes[some - 1], codes[some])]] = True
        starts = np.flatnonzero(fresh)
        length = np.diff(np.append(starts, n))
    parts = -(-length // LONGEST_UNIT)
    if (parts > 1).any():
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + k * LONGEST_UNIT
        length = np.diff(np.append(starts, n))
    return codes, starts, starts + length, np.searchsorted(starts, edge)


class Sampler:
    def __init__(self, model: dict, k: int):
        self.vocabulary, self.k = Vocabulary(model), k

    def pieces(self, flat: Flat, edges: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids along edges, and where those of each word begin."""
        ids = flat.ids[edges]
        if not len(ids) or ids.min() >= 0:
            return ids, starts
        code = -1 - ids.astype(np.int64)
        size = np.where(ids < 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        return self.vocabulary.spell(ids), np.concatenate([[0], np.cumsum(size)])[starts]

    def sample(self, keys: np.ndarray, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
        """(row, rank, ids, log probability, perturbed value, inclusion) of the k best segmentations of each text."""
        codes, first, last, edge = units(texts, self.vocabulary)
        seeds = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
        paths: list[list[Path]] = [[] for _ in texts]
        counts = np.diff(edge)
        if len(first):
            h = spans(sums(codes), first, last)
            order = np.argsort(h)
            fresh = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
            example, unit = order[fresh], np.empty(len(h), np.int64)
            unit[order] = np.cumsum(fresh) - 1
            length = (last - first)[example]
            at = np.repeat(first[example] - np.cumsum(length) + length, length) + np.arange(length.sum())
            flat = Flat(codes[at], length, self.vocabulary)
            place = np.arange(len(unit)) - np.repeat(edge[:-1], counts)
            seed = np.repeat(seeds, counts)
            edges, starts, log_p = draw(flat, unit, order, seed, place, 1)
            ids, places = self.pieces(flat, edges, starts)
            values = -np.log(-np.log(uniform(seeds, np.zeros(len(seeds), np.int64), 7)))
            before = segments(log_p, edge)
            off = off_values(before, log_p, np.repeat(values, counts), uniform(seed, place, 2))
            for d in np.flatnonzero(counts):
                a, b = edge[d], edge[d + 1]
                x, y = starts[a : b + 1], places[a : b + 1]
                paths[d].append(Path(edges[x[0] : x[-1]], x - x[0], ids[y[0] : y[-1]], y - y[0], log_p[a:b], before[a:b], off[a:b], float(values[d])))
        for r in range(2, self.k + 1):
            popped = []
            for d, mine in enumerate(paths):
                if len(mine) == r - 1:
                    best = max(mine, key=lambda p: p.off.max())
                    t = int(best.off.argmax())
                    if best.off[t] > -np.inf:
                        popped.append((d, best, t, float(best.off[t])))
            if not popped:
                break
            of = np.array([x[0] for x in popped])
            begin = edge[of] + np.array([x[2] for x in popped]) + 1
            size = edge[of + 1] - begin
            tail = np.concatenate([[0], np.cumsum(size)])
            some = np.repeat(begin - tail[:-1], size) + np.arange(tail[-1])
            own = np.repeat(of, size)
            where = np.full(len(unit), -1)
            where[some] = np.arange(len(some))
            where = where[order]
            edges, starts, log_p = draw(flat, unit[some], where[where >= 0], seeds[own], place[some], 10 * r)
            ids, places = self.pieces(flat, edges, starts)
            heads = []
            for d, path, t, value in popped:
                taken = path.taken.setdefault(t, [path.edges[path.starts[t] : path.starts[t + 1]]])
                other_edges, log_other = other(flat, int(unit[edge[d] + t]), taken, uniform(seeds[d : d + 1], np.arange(int(last[edge[d] + t] - first[edge[d] + t])), 40 * r))
                taken.append(other_edges)
                left = -np.expm1(np.logaddexp.reduce([flat.share[x].sum() for x in taken]))
                mass = path.before[t] + np.log(left) if left > 1e-12 else -np.inf
                path.off = path.off.copy()
                path.off[t] = branch(np.array(mass), value, uniform(seeds[d : d + 1], np.array([t]), 20 * r))[0] if mass > -np.inf else -np.inf
                heads.append((other_edges, log_other, path.before[t] + log_other))
            before = segments(log_p, tail) + np.repeat([x[2] for x in heads], size)
            off = off_values(before, log_p, np.repeat([x[3] for x in popped], size), uniform(seeds[own], place[some], 30 * r))
            for (d, path, t, value), (other_edges, log_other, _), a, b in zip(popped, heads, tail[:-1], tail[1:]):
                x, y = starts[a : b + 1], places[a : b + 1]
                head, shown = path.starts[t], path.places[t]
                spelled = self.vocabulary.spell(flat.ids[other_edges])
                paths[d].append(
                    Path(
                        np.concatenate([path.edges[:head], other_edges, edges[x[0] : x[-1]]]),
                        np.concatenate([path.starts[: t + 1], head + len(other_edges) + x - x[0]]),
                        np.concatenate([path.ids[:shown], spelled, ids[y[0] : y[-1]]]),
                        np.concatenate([path.places[: t + 1], shown + len(spelled) + y - y[0]]),
                        np.concatenate([path.log_p[:t], [log_other], log_p[a:b]]),
                        np.concatenate([path.before[: t + 1], before[a:b]]),
                        np.concatenate([np.full(t + 1, -np.inf), off[a:b]]),
                        value,
                    )
                )
        for d, mine in enumerate(paths):
            if not mine:
                yield d, 1, np.zeros(0, np.int64), 0.0, 0.0, 1.0
                continue
            limit = max(p.off.max() for p in mine) if len(mine) == self.k else -np.inf
            for rank, p in enumerate(mine, 1):
                total = float(p.before[-1] + p.log_p[-1])
                yield d, rank, p.ids, total, p.value, float(-np.expm1(-np.exp(min(total - limit, 700.0)))) if limit > -np.inf else 1.0


class Decoder:
    """Text of piece ids."""

    def __init__(self, table: list[bytes]):
        self.raw = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(x) for x in table], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def encoded(self, ids: np.ndarray) -> bytes:
        """UTF-8, without the space that stands before every text."""
        size = self.size[ids]
        done = np.cumsum(size) - size
        at = np.repeat(self.first[ids] - done, size) + np.arange(size.sum())
        return self.raw[at].tobytes()[1:]

    def __call__(self, ids: np.ndarray) -> str:
        return self.encoded(ids).decode("utf-8", "surrogatepass")


def text_hash(data: bytes) -> int:
    """What Spark's xxhash64 gives for a text."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def encode_samples(docs: DataFrame, model: dict, k: int = 2, key: str = "doc_id", hashed: bool = False) -> DataFrame:
    """key, rank, ids, text, log_prob, perturbed, inclusion: k distinct segmentations of every text, greatest first.

    text is decoded from ids, in the same pass; hashed gives its hash instead (text_hash), so that it stays in the task.
    """
    small_batches(docs.sparkSession)
    name, kind = ("text_hash", "long") if hashed else ("text", "string")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, decode = Sampler(sent.value, k), Decoder(sent.value["decode"])
        for b in batches:
            keys = b.column("seed").to_numpy()
            for lo, hi in slices(text_bytes(b.column("text"))[1], SLICE_BYTES):
                got = list(sampler.sample(keys[lo:hi], b.column("text").slice(lo, hi - lo).to_pylist()))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *(len(x[2]) for x in got)]).astype(np.int32), pa.array(np.concatenate([x[2] for x in got]).astype(np.int32)))
                texts = pa.array([text_hash(decode.encoded(x[2])) for x in got], pa.int64()) if hashed else pa.array([decode(x[2]) for x in got], pa.string())
                arrays = [b.column(key).take(pa.array([lo + x[0] for x in got])), pa.array([x[1] for x in got], pa.int32()), lists, texts, *(pa.array([x[i] for x in got], pa.float64()) for i in (3, 4, 5))]
                yield pa.RecordBatch.from_arrays(arrays, [key, "rank", "ids", name, "log_prob", "perturbed", "inclusion"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("seed"), "text")
    return rows.mapInArrow(run, f"{key} long, rank int, ids array<int>, {name} {kind}, log_prob double, perturbed double, inclusion double")


def encoded_rows(docs: DataFrame, model: dict, k: int = 2) -> DataFrame:
    """doc_id, rank, ids, n_pieces, log_prob, inclusion, text_hash (of the decoded pieces)."""
    rows = encode_samples(docs, model, k, hashed=True)
    return rows.select("doc_id", "rank", "ids", F.size("ids").cast("long").alias("n_pieces"), "log_prob", "inclusion", "text_hash")


def op5_sentencepiece(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded_rows(docs, load_pieces())
