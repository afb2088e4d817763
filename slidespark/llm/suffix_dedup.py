"""Removal of repeated byte strings by a partitioned suffix order with longest-previous-factor arrays.

Every byte position that starts a full window of ``length`` bytes is a suffix cut at
that length. Suffixes are sent to the partition of their *anchor*, the leftmost
``ANCHOR``-byte string of least hash inside the window: equal windows have equal anchors
at equal distances, so a partition holds all the neighbours that a suffix can have in the
global suffix order up to ``length``. Consecutive windows with one anchor travel as one
run (start, end, fingerprint of the covered bytes), about one row for 69 bytes of text.

A run whose covered bytes recur as a whole (128 bits of fingerprints) settles all its windows
at once. Runs that share an anchor but differ around it are opened: their suffixes are sorted
by their bytes, ties by position. Where neighbours in that order have ``length`` bytes in
common they form a plateau; the previous or next smaller position of a suffix lies in its
plateau exactly if the suffix is not the earliest there, and only then its longest previous
factor reaches ``length``. (Values below ``length`` decide nothing and are not computed.)
Around an anchor with more than ``open_at_once`` kinds of runs the plateaus are groups of rows
by two fingerprints of the window, 128 bits, which deal out over all tasks.

Results (also for odd inputs):

* null and empty texts, and texts shorter than ``length``, lose nothing;
* very long texts are read in pieces that overlap by ``length - 1`` bytes;
* matches never cross documents; each row is a document of its own. Copies stand in order of id,
  of a digest of id and text, and of place; rows alike in id *and* text share one position when
  the first copy is kept, so that both are kept;
* null ids rank before all others; extra columns are kept, unless they clash with the
  names of the result, which win;
* an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidespark.sources.storage import materialize, release

from . import textops as T

LENGTH = 200
ANCHOR = 64
#: Windows of a very long text that are read at once.
PIECE = 1 << 19
U64 = np.uint64
#: Codes of a second fingerprint.
OTHER = T.ODD[1024:1280]
_POS = U64((1 << 30) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, in three passes whatever ``w`` is."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    grid = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: document, first and last start in it, anchor and content fingerprints.

    A run's content fingerprint covers its bytes and the anchor's distance from its start.
    """
    none = {k: np.zeros(0, np.int64) for k in ("doc", "first", "last", "anchor", "content")}
    n = len(data)
    if n < length:
        return none
    prefix = T.hash_prefix(data)
    at = np.arange(n - anchor + 1)
    grams = T.hash_spans(prefix, at, at + anchor)
    owner = sliding_min((grams >> U64(30) << U64(30)) | at.astype(U64), length - anchor + 1) & _POS
    ends = np.repeat(off[1:], np.diff(off))
    valid = np.flatnonzero(ends[: len(owner)] - at[: len(owner)] >= length)
    if not len(valid):
        return none
    owner = owner[valid].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    first, last, owner = valid[new], valid[np.concatenate([new[1:], [len(valid)]]) - 1], owner[new]
    doc = np.searchsorted(off, first, "right") - 1
    content = T.mix(T.hash_spans(prefix, first, last + length) + (owner - first).astype(U64) * T.ODD[50])
    return {"doc": doc, "first": first - off[doc], "last": last - off[doc], "anchor": T.signed(grams[owner]), "content": T.signed(content)}


def windows(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows that start in the given ranges of ``data``: index of the range, start."""
    size = last - first + 1
    which = np.repeat(np.arange(len(size)), size)
    return which, first[which] + np.arange(len(which)) - (np.cumsum(size) - size)[which]


_RUNS = "anchor long, content long, key binary, rank long, first int, last int"
#: Runs around one anchor that are opened within one task; an anchor with more goes through window rows, which deal out evenly.
OPEN_AT_ONCE = 500


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint unions of closed ranges; touching ones join."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1] + 1]))
    return first[new], reach[np.concatenate([new[1:], [len(first)]]) - 1]


def _pieces(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of documents as (first document, its bytes before, bytes, offsets); a long document comes in several."""
    for i, j in T.slices(off):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= PIECE + length:
            yield i, 0, data[lo:hi], off[i : j + 1] - lo
            continue
        for at in range(lo, hi - length + 1, PIECE):
            part = data[at : min(hi, at + PIECE + length - 1)]
            yield i, at - lo, part, np.array([0, len(part)])


def _emit_runs(length: int, anchor: int, keep_first: bool):
    """Runs of every document, each kind once in a piece; what repeats within one comes as ranges without an anchor."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.buffer(batch.column("text"))
            for i, before, part, at in _pieces(data, off, length):
                r = runs(part, at, length, anchor)
                order = np.lexsort((r["first"], r["content"], r["anchor"], r["doc"]))
                doc, a, c, s, e = (r[k][order] for k in ("doc", "anchor", "content", "first", "last"))
                if not len(doc):
                    continue
                again = np.zeros(len(doc), bool)
                again[1:] = (doc[1:] == doc[:-1]) & (a[1:] == a[:-1]) & (c[1:] == c[:-1])
                gone = again.copy()
                if not keep_first:
                    gone[:-1] |= again[1:]
                wide = doc.astype(np.int64) << 32
                ms, me = _merged((wide + s)[gone], (wide + e)[gone])
                rows = pa.array(np.concatenate([doc[~again], ms >> 32]) + i)
                none = np.zeros(len(ms), np.int64)
                here = ~again
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([a[here], none]), mask=np.concatenate([np.zeros(here.sum(), bool), np.ones(len(ms), bool)])),
                        pa.array(np.concatenate([c[here], none])),
                        batch.column("key").take(rows),
                        batch.column("rank").take(rows),
                        pa.array((np.concatenate([s[here], ms & 0xFFFFFFFF]) + before).astype(np.int32)),
                        pa.array((np.concatenate([e[here], me & 0xFFFFFFFF]) + before).astype(np.int32)),
                    ],
                    names=["anchor", "content", "key", "rank", "first", "last"],
                )

    return f


def _cut_runs(length: int):
    """The bytes that each listed run covers."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.buffer(batch.column("text"))
            counts = np.diff(np.asarray(batch.column("runs").offsets))
            flat = batch.column("runs").flatten()
            of = np.repeat(np.arange(len(batch)), counts)
            lo, hi = (off[of] + flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "last"))
            ends = np.concatenate([[0], np.cumsum(hi + length - lo)])
            for i, j in T.slices(ends):
                which, start = windows(data, lo[i:j], hi[i:j] + length - 1)
                at = pa.array((ends[i : j + 1] - ends[i]).astype(np.int32))
                bytes_ = pa.Array.from_buffers(pa.binary(), j - i, [None, at.buffers()[1], pa.py_buffer(data[start].tobytes())])
                own = pa.array(of[i:j])
                part = flat.slice(i, j - i)
                cols = [part.field("anchor"), part.field("many"), part.field("settled"), batch.column("key").take(own), batch.column("rank").take(own), part.field("first"), bytes_]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "many", "settled", "key", "rank", "first", "bytes"])

    return f


def _opened(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the runs in a batch and all their windows: index of the run, start in the bytes and in the document."""
    column = batch.column("bytes")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    which, at = windows(data, off[:-1], off[1:] - length)
    return data, which, at, at - off[which] + batch.column("first").to_numpy()[which]


def _repeat_ranges(key: pa.Array, which: np.ndarray, start: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Ranges of hit windows, one row for each maximal range of a run."""
    w, s = which[hit], start[hit]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.concatenate([at[1:], [len(w)]])[: len(at)] - 1
    return pa.RecordBatch.from_arrays([key.take(pa.array(w[at])), pa.array(s[at].astype(np.int32)), pa.array(s[end].astype(np.int32))], names=["key", "first", "last"])


def suffix_order(data: np.ndarray, at: np.ndarray, length: int, *position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes cut at ``length`` in order of their bytes, ties by position (most significant part last), and which continue a plateau."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    order = np.lexsort(position)
    texts = np.ascontiguousarray(view[at[order]]).view(f"S{length}").ravel()
    by = np.argsort(texts, kind="stable")
    same = np.zeros(len(at), bool)
    same[1:] = texts[by[1:]] == texts[by[:-1]]
    return order[by], same


def _settle_groups(length: int, keep_first: bool):
    """Opens the runs of whole anchors, sorted by anchor, and finds the windows whose longest previous factor (or, to drop all copies, longest factor elsewhere) is whole."""

    def solve(part: pa.RecordBatch) -> pa.RecordBatch:
        data, which, at, start = _opened(part, length)
        if not len(which):
            return _repeat_ranges(part.column("key"), which, start, np.zeros(0, bool))
        digest = np.frombuffer(b"".join(part.column("key").to_pylist()), ">u8").reshape(-1, 2).astype(U64)
        one, two, rank = digest[which, 0], digest[which, 1], part.column("rank").to_numpy()[which]
        order, same = suffix_order(data, at, length, start, two, one, rank)
        if keep_first:  # the earliest of a plateau, and rows that share its position, have no smaller position before or after them
            lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            same &= (start[order] != start[lead]) | (one[order] != one[lead]) | (two[order] != two[lead])
        else:
            same[:-1] |= same[1:]
        hit = np.zeros(len(order), bool)
        hit[order] = same
        return _repeat_ranges(part.column("key"), which, start, hit & ~part.column("settled").to_numpy(zero_copy_only=False)[which])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            a = batch.column("anchor").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1]) if len(a) else np.zeros(1, int)
            i = 0
            while i < edges[-1]:
                j = int(edges[np.searchsorted(edges, i + OPEN_AT_ONCE, "right") - 1])
                j = j if j > i else int(edges[np.searchsorted(edges, i, "right")])
                yield solve(batch.slice(i, j - i))
                i = j
            rest = batch.slice(int(edges[-1]))
        if rest is not None and len(rest):
            yield solve(rest)

    return f


def _open_rows(length: int):
    """One row for each window of the runs around very common anchors."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), OPEN_AT_ONCE):
                part = batch.slice(i, OPEN_AT_ONCE)
                data, which, at, start = _opened(part, length)
                prints = [pa.array(T.signed(T.hash_spans(T.hash_prefix(data, code), at, at + length))) for code in (T.BYTE_CODE, OTHER)]
                rows = pa.array(which)
                yield pa.RecordBatch.from_arrays([*prints, *(part.column(c).take(rows) for c in ("key", "rank", "settled")), pa.array(start.astype(np.int32))], names=["one", "two", "key", "rank", "settled", "first"])

    return f


def _apply(length: int, names: list[str], as_text: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.buffer(batch.column("__text"))
            spans = batch.column("__spans")
            at = np.asarray(spans.offsets) - np.asarray(spans.offsets)[0]
            flat = spans.flatten()
            first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "last"))
            for i, j in T.slices(off):
                kept, removed, count = [], [], []
                for k in range(i, j):
                    text = data[off[k] : off[k + 1]]
                    s, e = _merged(first[at[k] : at[k + 1]], last[at[k] : at[k + 1]] + length - 1)
                    if len(s):
                        edge = np.zeros(len(text) + 1, np.int8)
                        edge[s], edge[e + 1] = 1, -1
                        text = text[np.cumsum(edge[:-1]) == 0]
                    kept.append(text.tobytes().decode("utf-8", "ignore") if as_text else text.tobytes())
                    removed.append(int((e - s + 1).sum()))
                    count.append(len(s))
                new = [pa.array(np.diff(off[i : j + 1])), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), *new], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return f


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = True, open_at_once: int = OPEN_AT_ONCE, as_text: bool = False) -> DataFrame:
    """Cuts from every text the bytes covered by a ``length``-byte string that occurs elsewhere too.

    ``keep_first`` (longest previous factors): the earliest copy in order of id and
    position stays; otherwise all copies go. Adds ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs) and ``kept`` (the remaining bytes, which may split a character; with
    ``as_text`` the remaining text, without the bytes of split characters).
    Ids are numbers or can be cast to them.
    """
    anchor = max(1, min(ANCHOR, length // 2))
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("/"), F.coalesce(F.col(text_col), F.lit("")))))
    texts = docs.select(F.col(text_col).alias("text"), key.alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("rank"))
    found = materialize(texts.mapInArrow(_emit_runs(length, anchor, keep_first), _RUNS))
    place = F.struct("rank", "key", "first")

    common = found.where("anchor is not null").groupBy("anchor").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("mixed")).where("n > 1").drop("n")
    again = materialize(found.join(common, "anchor"))
    kinds = materialize(again.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(place).alias("lead")))
    whole = again.join(kinds.where("copies > 1"), ["anchor", "content"])
    if keep_first:
        whole = whole.where(place > F.col("lead"))

    # one run of each kind around anchors that have several kinds: their windows are compared one by one
    mixed = kinds.join(kinds.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "anchor")
    leads = (
        again.where("mixed")
        .join(mixed, ["anchor", "content"])
        .where(place == F.col("lead"))
        .groupBy("anchor", "content")
        .agg(*(F.first(c).alias(c) for c in ("key", "first", "last", "copies", "m")))
        .groupBy("key")
        .agg(F.collect_list(F.struct("anchor", (F.col("m") > open_at_once).alias("many"), (F.lit(not keep_first) & (F.col("copies") > 1)).alias("settled"), "first", "last")).alias("runs"))
    )
    one_text = texts.join(leads, "key").dropDuplicates(["key"])
    opened = materialize(one_text.mapInArrow(_cut_runs(length), "anchor long, many boolean, settled boolean, key binary, rank long, first int, bytes binary"))
    few = opened.where("not many").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_settle_groups(length, keep_first), "key binary, first int, last int")
    rows = opened.where("many").mapInArrow(_open_rows(length), "one long, two long, key binary, rank long, settled boolean, first int")
    plateaus = rows.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(place).alias("lead")).where("n > 1")
    many = rows.join(plateaus, ["one", "two"]).where((place > F.col("lead")) if keep_first else ~F.col("settled")).select("key", "first", F.col("first").alias("last"))

    parts = [found.where("anchor is null"), whole, few, many]
    spans = parts[0].select("key", "first", "last")
    for p in parts[1:]:
        spans = spans.unionByName(p.select("key", "first", "last"))
    spans = materialize(spans.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("__spans")).withColumnRenamed("key", "__key"))
    release(found, again, kinds, opened)
    # by merging at any size, so that disk grows in proportion
    joined = docs.select(*names, F.col(text_col).alias("__text"), key.alias("__key")).join(spans.hint("merge"), "__key", "left").drop("__key")
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*names).dtypes)
    return joined.mapInArrow(_apply(length, names, as_text), f"{fields}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def digest(docs: DataFrame) -> DataFrame:
    """All copies of 200-byte strings removed: sizes, counts and a hash of what remains, by document."""
    out = remove_repeats(docs.select("doc_id", "text"), keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(length: int = LENGTH, step: int = 500) -> str:
    """The same in DuckDB, with all windows in one table; texts are cut into overlapping pieces so that substrings stay short."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT rid, doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
p AS (
  SELECT rid, n, k, substring(h, 2 * k + 1, {2 * (step + length - 1)}) AS piece
  FROM (SELECT rid, n, h, unnest(range(0, greatest(n - {length - 1}, 0), {step})) AS k FROM n)),
w AS (
  SELECT rid, k + j AS s, md5(substring(piece, 2 * j + 1, {2 * length})) AS f
  FROM (SELECT rid, k, piece, unnest(range(0, least({step}, n - {length - 1} - k))) AS j FROM p)),
hit AS (SELECT DISTINCT rid, s FROM w WHERE f IN (SELECT f FROM w GROUP BY f HAVING count(*) > 1)),
mark AS (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + {length} THEN 0 ELSE 1 END AS fresh FROM hit),
span AS (
  SELECT rid, g, min(s) AS a, max(s) + {length} AS b
  FROM (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS g FROM mark) GROUP BY rid, g),
cut AS (
  SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(part, '' ORDER BY a) AS parts
  FROM (SELECT span.*, substring(h, 2 * before + 1, 2 * (a - before)) AS part
        FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM span) span JOIN n USING (rid)) GROUP BY rid)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN cut.rid IS NULL THEN h ELSE parts || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM n LEFT JOIN cut ON n.rid = cut.rid"""


def brute_force(texts: list[str | None], length: int = LENGTH, keep_first: bool = False) -> list[bytes]:
    """What remains of each text, in order of position, by a table of all windows."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for d, t in enumerate(raw):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((d, s))
    gone = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        for d, s in places[1 if keep_first else 0 :] if len(places) > 1 else []:
            gone[d][s : s + length] = True
    return [bytes(np.frombuffer(t, np.uint8)[~g]) for t, g in zip(raw, gone, strict=True)]


def sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
