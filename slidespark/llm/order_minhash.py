"""Near-duplicate documents by order MinHash with banded alignment of the candidates.

A text is the sequence of its five-word shingles (``A-Z`` folded; fewer than five words are
one shingle), each labelled with its occurrence number, so that no label comes twice. The
similarity of two texts is ``L / (n + m - L)``, with ``L`` the longest common subsequence of
their labelled shingles: at most the multiset Jaccard similarity, and below it where order
differs. One minus it is a metric (the Steinhaus transform of the insert-delete distance).
Texts are linked at 0.8 or more; a class is a connected component of links.

1. Texts with equal word sequences are one vertex (128-bit fingerprint).
2. ``bands`` sketches each keep the ``mins`` labelled shingles of least hash in text order;
   vertices with an equal sketch share a bucket. At similarity 0.8 a sketch of a long text agrees
   with chance 0.8 ** 3 = 0.51, so all 20 bands miss a link with chance below 1e-6 (2e-6 at 15
   shingles). Texts so short that a link leaves out at most two shingles of either are linked
   exactly: their sequences with up to two left out are keys, and of all that share a key the one
   that leaves out least is compared with the rest, which holds every link to the others.
3. In buckets of up to ``small`` vertices all pairs are candidates; in larger ones the pairs with
   two hubs (least and greatest), which put the copies of one text into one class.
4. Vertices of larger buckets that those links leave in several classes are joined exactly, over
   all of them at once: linked texts share one of the rarest shingles that make up the first fifth
   of each and one more. Pairs are made only between classes (of the members of a shingle, those
   outside its largest class with all others), in blocks of ``BLOCK`` texts, and only where
   lengths, places and the bitmaps below allow a link.
5. Before any text is moved, a bitmap of 512 bits, in which each label flips one, bounds what two
   texts can have in common: ``n + m`` less the bits in which they differ, halved.
6. What is left is aligned: as labels are unique, the longest common subsequence is a longest
   increasing run of positions, within the band of ``(n + m) / 9`` shifts that similarity 0.8 allows.

Null texts and texts without a word are classes of their own; repeated rows and ids are
rows of one class if their texts are alike; a null id is in the class of its text (whose
class id is the least id that is not null); an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidespark.operators.components import components
from slidespark.sources.storage import materialize, release

from . import textops as T

THRESHOLD = 0.8
SHINGLE = 5
#: Minima of a sketch and sketches of a text.
MINS, BANDS = 3, 20
SMALL = 8
#: Members of a block; two blocks of a shingle's texts meet in one group.
BLOCK = 1024
#: Words of 64 bits in a bitmap.
WORDS = 8
#: Shingles times bands that are hashed at once.
AT_ONCE = 1 << 19
_SKETCHED = "id {}, digest string, v binary, n int, keys array<long>, cuts array<long>, bits array<long>"
U64 = np.uint64


def labelled(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled shingles of each document, their offsets, and a 16-byte fingerprint of its words."""
    words, first = T.word_hashes(data, off)
    x, at = T.shingle_hashes(words, first, k)
    counts = np.diff(first)
    place = (np.arange(len(words)) - np.repeat(first[:-1], counts)).astype(U64)
    ends = np.zeros((2, len(words) + 1), U64)
    for row, salt in zip(ends, (11, 12), strict=True):
        np.cumsum(T.mix(words + place * T.ODD[salt] + T.ODD[salt + 10]), out=row[1:])
    prints = np.stack([T.mix(row[first[1:]] - row[first[:-1]] + counts.astype(U64) * T.ODD[9]) for row in ends], axis=1)
    return T.occurrence_labels(x, at), at, np.ascontiguousarray(prints)


def sketches(x: np.ndarray, mins: int, bands: int, seed: int = 0) -> np.ndarray:
    """Order MinHash of one document: for each band, a hash of its least labels in text order."""
    out = np.arange(1, bands + 1).astype(U64) * T.ODD[60] + U64(seed)
    step = max(1, AT_ONCE // max(1, len(x)))
    for b in range(0, bands, step):
        part = out[b : b + step]
        if len(x) <= mins:
            kept = np.broadcast_to(x, (len(part), len(x)))
        else:
            hashed = x[None, :] * T.ODD[100 + seed + b : 100 + seed + b + len(part), None]
            hashed ^= hashed >> U64(32)
            least = np.argpartition(hashed, mins, axis=1)[:, :mins]
            least.sort(axis=1)
            kept = x[least]
        for i in range(kept.shape[1]):
            part = T.mix(part + kept[:, i] * T.ODD[61])
        out[b : b + step] = part
    return out


def bitmaps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document, ``WORDS`` words in which every label has flipped one bit."""
    docs, size = len(first) - 1, 64 * WORDS
    doc = np.repeat(np.arange(docs), np.diff(first))
    bit = ((x * T.ODD[63]) >> U64(40)).astype(np.int64) % size
    odd = np.bincount(doc * size + bit, minlength=docs * size) & 1
    return np.packbits(odd.astype(np.uint8).reshape(docs, size), axis=1).view(np.int64)


def most_cut(n: int, threshold: float = THRESHOLD) -> int:
    """How many of ``n`` shingles a link can leave out."""
    return int(n * (1 - threshold) + 1e-9)


def cut_keys(x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """A hash of the sequence and of each with one and with two left out, as far as a link allows; none if it allows more."""
    n, most = len(x), most_cut(len(x), threshold)
    if most > 2:
        return np.zeros(0, U64)
    parts = []
    for d in range(most + 1):
        out = np.array(list(combinations(range(n), d)), np.int64).reshape(comb(n, d), d)
        keep = np.ones((len(out), n), bool)
        keep[np.arange(len(out))[:, None], out] = False
        kept = np.broadcast_to(x, keep.shape)[keep].reshape(len(out), n - d)
        key = np.full(len(out), U64(n - d) * T.ODD[62])
        for i in range(n - d):
            key = T.mix(key + kept[:, i] * T.ODD[61])
        parts.append(key)
    return np.concatenate(parts)


def similarity(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Longest common subsequence over union of unique labels; -1 where it can't reach the threshold."""
    n, m = len(x), len(y)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return -1.0
    order = np.argsort(y)
    at = np.searchsorted(y[order], x)
    at[at == m] = m - 1
    pos = order[at]
    hit = y[pos] == x
    need = threshold * (n + m) / (1 + threshold) - 1e-9
    if hit.sum() < need:
        return -1.0
    band = n + m - 2 * need
    where = np.flatnonzero(hit)
    steps = pos[where]
    steps = steps[np.abs(steps - where) <= band]
    if (steps[1:] > steps[:-1]).all():
        common = len(steps)
    else:
        tails: list[int] = []
        for s in steps.tolist():
            i = bisect_left(tails, s)
            if i == len(tails):
                tails.append(s)
            else:
                tails[i] = s
        common = len(tails)
    score = common / (n + m - common)
    return score if score >= threshold - 1e-12 else -1.0


def _sketch(mins: int, bands: int, threshold: float):
    """Sketches, bitmaps, and the cut keys of short texts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.buffer(batch.column("text"))
            for i, j, part, at in T.chunks(data, off):
                x, first, prints = labelled(part, at)
                n = np.diff(first)
                keys = np.zeros((j - i, bands), U64)
                cuts = [np.zeros(0, U64)] * (j - i)
                for k in np.flatnonzero(n):
                    one = x[first[k] : first[k + 1]]
                    keys[k] = sketches(one, mins, bands)
                    cuts[k] = cut_keys(one, threshold)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(i, j - i),
                        batch.column("digest").slice(i, j - i),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), j - i, [None, pa.py_buffer(prints.tobytes())]).cast(pa.binary()),
                        pa.array(n.astype(np.int32)),
                        _table(T.signed(keys)),
                        _lists(cuts),
                        _table(bitmaps(x, first)),
                    ],
                    names=["id", "digest", "v", "n", "keys", "cuts", "bits"],
                )

    return f


def _table(x: np.ndarray) -> pa.ListArray:
    rows, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)[: rows + 1]), pa.array(x.ravel()))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(T.signed(np.concatenate(parts))))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, xs): the labelled shingles of each text."""
    for batch in batches:
        data, off = T.buffer(batch.column("text"))
        for i, j, part, at in T.chunks(data, off):
            x, first, _ = labelled(part, at)
            xs = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(T.signed(x)))
            yield pa.RecordBatch.from_arrays([batch.column("v").slice(i, j - i), xs], names=["v", "xs"])


def _verify(threshold: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [T.buffer(batch.column(c)) for c in ("text_a", "text_b")]
            for i, j in T.slices(sides[0][1] + sides[1][1]):
                (x, p), (y, q) = (labelled(data[off[i] : off[j]], off[i : j + 1] - off[i])[:2] for data, off in sides)
                keep = pa.array([similarity(x[p[k] : p[k + 1]], y[q[k] : q[k + 1]], threshold) >= 0 for k in range(j - i)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return f


def _candidates(members: DataFrame, small: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs to align, the members (key, v) of large buckets, and the table that both read, from (v, n, key)."""
    sized = members.groupBy("key").agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("m > 1")
    crowd = materialize(members.join(sized, "key"))
    few, many = crowd.where(F.col("m") <= small), crowd.where(F.col("m") > small)
    left = few.select("key", F.col("v").alias("a"), F.col("n").alias("na"))
    right = few.select("key", F.col("v").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("a", "b")
    spokes = [many.where(F.col("v") != F.col(h)).select(F.least("v", h).alias("a"), F.greatest("v", h).alias("b")) for h in ("lo", "hi")]
    return pairs.union(spokes[0]).union(spokes[1]), many.select("key", "v"), crowd


def _short_pairs(vertices: DataFrame, threshold: float) -> DataFrame:
    """Pairs that hold all links of short texts: of the vertices of each key, the one that leaves out least with all others.

    With ``d`` and ``e`` of the two left out beside ``c`` common ones, a link is ``c / (c + d + e)`` at the
    threshold or more; where that holds for two vertices, it holds for each of them and the one that leaves out least.
    """
    cut = vertices.select("v", "n", F.posexplode("cuts").alias("k", "key")).select("v", "n", "key", F.when(F.col("k") == 0, 0).when(F.col("k") <= F.col("n"), 1).otherwise(2).alias("d"))
    lead = cut.groupBy("key").agg(F.min(F.struct("d", "v")).alias("lo"), F.count("*").alias("m")).where("m > 1").select("key", "lo")
    common = F.col("n") - F.col("d")
    near = cut.join(lead, "key").where((F.col("v") != F.col("lo.v")) & (common >= threshold * (common + F.col("d") + F.col("lo.d")) - 1e-9))
    return near.select(F.least("v", "lo.v").alias("a"), F.greatest("v", "lo.v").alias("b")).distinct()


def _fit(threshold: float):
    """Whether sizes and bitmaps of (na, ba) and (nb, bb) allow a link."""
    apart = sum((F.bit_count(F.col("ba")[i].bitwiseXOR(F.col("bb")[i])) for i in range(WORDS)), F.lit(0))
    need = threshold * (F.col("na") + F.col("nb")) / (1 + threshold) - 1e-9
    return (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & ((F.col("na") + F.col("nb") - apart) / 2 >= need)


def _rest_pairs(held: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b), and the table that they read, of all links of (v, root, n, bits, text) between different roots, by the rarest shingles of each.

    A link has ``threshold * n`` shingles in common or more, so with all shingles in one order two linked
    texts share one among the first ``n - threshold * n + 1`` of each; after the first that they share, enough must follow.
    """
    x = materialize(held.select("v", "text").mapInArrow(_shingles, "v binary, xs array<long>").select("v", F.size("xs").alias("n"), F.explode("xs").alias("x")))
    often = x.groupBy("x").agg(F.count("*").alias("often"))
    order = Window.partitionBy("v").orderBy("often", "x")
    first = x.join(often, "x").withColumn("at", F.row_number().over(order)).where((F.col("often") > 1) & (F.col("at") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1))
    first = materialize(first.select("v", "x", "at").join(held.select("v", "root", "n", "bits"), "v"))
    release(x)
    kinds = first.groupBy("x", "root").agg(F.count("*").alias("m"))
    shared = kinds.groupBy("x").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("most")).where("m > most.m")
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    shared = shared.select("x", F.col("most.root").alias("major"), blocks(F.col("m") - F.col("most.m")).alias("rows"), blocks(F.col("m")).alias("cols"))
    dealt = first.join(shared, "x")
    own = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda df, c: df.select("x", "i", "j", F.col("v").alias(c), F.col("root").alias(f"r{c}"), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"), (F.col("n") - F.col("at")).alias(f"t{c}"), (F.col("root") == F.col("major")).alias(f"m{c}"))
    minor = side(dealt.where(F.col("root") != F.col("major")).withColumn("i", own("rows")).withColumn("j", every("cols")), "a")
    both = minor.join(side(dealt.withColumn("j", own("cols")).withColumn("i", every("rows")), "b"), ["x", "i", "j"])
    enough = 1 + F.least("ta", "tb") >= threshold * (F.col("na") + F.col("nb")) / (1 + threshold) - 1e-9
    found = both.where((F.col("ra") != F.col("rb")) & (F.col("mb") | (F.col("a") < F.col("b"))) & enough & _fit(threshold))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), first


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, small: int = SMALL, bands: int = BANDS, mins: int = MINS) -> tuple[DataFrame, DataFrame]:
    """(id, v, n) of every row with the vertex of its text, and (v, root) of all vertices that have a link."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(F.col(text_col)).alias("digest"))
    rows = materialize(texts.mapInArrow(_sketch(mins, bands, threshold), _SKETCHED.format(dict(texts.dtypes)["id"])))
    vertices = materialize(rows.where("n > 0").groupBy("v").agg(F.min(F.struct("digest", "id")).alias("lead"), *(F.first(c).alias(c) for c in ("n", "keys", "cuts", "bits"))))
    pairs, large, crowd = _candidates(vertices.select("v", "n", F.explode("keys").alias("key")), small, threshold)
    pairs = materialize(pairs.union(_short_pairs(vertices, threshold)).distinct())
    end = lambda c: vertices.select(F.col("v").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    pairs, old = materialize(pairs.join(end("a"), "a").join(end("b"), "b").where(_fit(threshold)).select("a", "b")), pairs
    release(old)
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    edges = _links(pairs, _texts(texts, vertices.join(wanted, "v")), threshold)
    roots = components(edges)
    release(edges, pairs)

    classes = large.join(roots, "v", "left").select("key", "v", F.coalesce("root", "v").alias("root"))
    open_ = classes.groupBy("key").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("key")
    again = materialize(classes.join(open_, "key").select("v", "root").distinct())
    release(crowd)
    if not again.isEmpty():
        rest = vertices.join(again, "v")
        held = materialize(_texts(texts, rest).join(rest.select("v", "root", "n", "bits"), "v"))
        pairs, first = _rest_pairs(held, threshold)
        pairs = materialize(pairs.distinct())
        release(first)
        new = _links(pairs, held, threshold)
        release(pairs, held)
        ends = [again.select(F.col("v").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
        up = components(new.join(ends[0], "a").join(ends[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        to = up.select(F.col("v").alias("root"), F.col("root").alias("top"))
        alone = up.join(roots, "v", "left_anti").select("v", "root")
        roots, old = materialize(roots.join(to, "root", "left").select("v", F.coalesce("top", "root").alias("root")).union(alone)), roots
        release(old, new, up)
    release(again)
    return rows.select("id", "v", "n"), roots


def _links(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are links, from the texts (v, text) of their ends."""
    both = pairs
    for c in "ab":
        both = both.join(held.select(F.col("v").alias(c), F.col("text").alias(f"text_{c}")), c)
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(threshold), "a binary, b binary"))


def _texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, text): one text for each wanted vertex, by the digest and id that lead it."""
    wanted = wanted.select(F.col("v"), F.col("lead.digest").alias("d"), F.col("lead.id").alias("i"))
    return texts.join(wanted, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i"))).select("v", "text").dropDuplicates(["v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, small: int = SMALL, bands: int = BANDS, mins: int = MINS) -> DataFrame:
    """(id, class_id, n) of every row; the class id is the least id of its class, or its own id where the text has no word."""
    rows, roots = link(docs, id_col, text_col, threshold, small, bands, mins)
    vertex = rows.where("n > 0").groupBy("v").agg(F.min("id").alias("lead")).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    names = vertex.groupBy("root").agg(F.min("lead").alias("class_id"))
    classes = vertex.join(names, "root").select(F.col("v").alias("w"), "class_id")
    out = rows.join(classes, (F.col("v") == F.col("w")) & (F.col("n") > 0), "left")
    return out.select("id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.col("n").cast("long").alias("n"))


def digest(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), "class_id", F.col("n").alias("n_shingles"), F.col("id").eqNullSafe(F.col("class_id")).alias("representative"))


def brute_force(texts: list[str | None], threshold: float = THRESHOLD) -> list[int]:
    """Class of each text as its first member, from all pairs and the full alignment table."""
    seqs = []
    for t in texts:
        w = (t or "").encode().lower().split()
        s = [tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
        seen: dict = {}
        out = []
        for x in s:
            seen[x] = seen.get(x, 0) + 1
            out.append((x, seen[x]))
        seqs.append(out)
    parent = list(range(len(texts)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(seqs):
        for j in range(i):
            y = seqs[j]
            if not x or not y:
                continue
            row = [0] * (len(y) + 1)
            for u in x:
                last = row[:]
                for q, v in enumerate(y):
                    row[q + 1] = last[q] + 1 if u == v else max(last[q + 1], row[q])
            if row[-1] / (len(x) + len(y) - row[-1]) >= threshold - 1e-12:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]
