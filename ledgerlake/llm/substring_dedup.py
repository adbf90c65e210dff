"""Long passages that occur in an earlier document, found with FM-indexes of shards.

A window is ``window`` consecutive words. Texts are cut into segments: runs of windows whose rarest shingle (by
corpus-wide counts) is the same. Equal windows always have the same one, so segments are dealt to shards by it, and a
window never has to be looked for in another shard. Shingles seen in one document only need no search. Equal
segments are one, with their smallest document, before they reach a shard, so copies by the thousands cost as
much as one.

Each shard is indexed (words in a Burrows-Wheeler text over a wavelet tree) and its segments are streamed backwards
through the index. The match at each word, shortened to the threshold, gives the smallest document that has the
window; stretches of windows with the same answer are reported as intervals. They go back to all documents with the
segment by a join, which adaptive execution splits for a passage that a third of the documents share.

A word is removed if a window over it also starts in a document with a smaller number. Null texts have no words.
Null numbers come after all others. Rows that share a number do not remove each other's words. Words are compared
as 64-bit hashes. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import row_key, written
from ledgerlake.llm.fm_index import FmIndex
from ledgerlake.llm.sketch import BITS, shingle_counts, slots
from ledgerlake.llm.wordhash import mix, windows, words

WINDOW = 50
SHINGLE = 8
KIND = "space"
SHARD_SEGMENTS = 20_000
MOST_WINDOWS = 64
LAST = (1 << 63) - 1
_SEGMENT = "doc long, _h long, start int, n int, mz long, ch long"


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values, by doubling."""
    span, out = 1, x
    while 2 * span <= size:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[:len(x) - size + 1], out[size - span:size - span + len(x) - size + 1])


def segments(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc, _h, start (word), n (windows), mz (rarest shingle), ch (hash of the segment's words)."""
    levels = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, KIND, shingle))

    def cut(batches):
        for batch in batches:
            for w in words(batch.column("text"), KIND):
                if len(w.hashes) < window:
                    continue
                sh = windows(w.hashes, shingle)
                rank = (levels.value[slots(sh, BITS)].astype(np.uint64) << np.uint64(58)) | (mix(sh) >> np.uint64(6))
                least = _sliding_min(rank, window - shingle + 1)
                first, count = w.bound[:-1], np.diff(w.bound) - window + 1
                rows = np.flatnonzero(count > 0)
                if not len(rows):
                    continue
                # Places of all windows that lie in one row, and where a new segment begins.
                size = count[rows]
                place = np.arange(size.sum()) + np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                row = np.repeat(rows, size)
                mz = least[place]
                new = np.concatenate([[True], (mz[1:] != mz[:-1]) | (row[1:] != row[:-1])])
                head = np.flatnonzero(new)
                run = np.diff(np.concatenate([head, [len(place)]]))
                if run.max() > MOST_WINDOWS:  # repetitive text: cut long runs
                    parts = -(-run // MOST_WINDOWS)
                    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    head = np.repeat(head, parts) + inner * MOST_WINDOWS
                    run = np.diff(np.concatenate([head, [len(place)]]))
                start = place[head]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc").take(pa.array(w.first + row[head])), batch.column("_h").take(pa.array(w.first + row[head])),
                    pa.array(start - first[row[head]], pa.int32()), pa.array(run, pa.int32()),
                    pa.array(mix(mz[head]).view(np.int64)), pa.array(_span_hash(w.hashes, start, run + window - 1).view(np.int64))],
                    ["doc", "_h", "start", "n", "mz", "ch"])

    return _numbered(docs).mapInArrow(cut, _SEGMENT)


def _span_hash(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    from ledgerlake.llm.wordhash import _WORDS

    up, down = _WORDS(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * up, out=total[1:])
    return mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))


def _numbered(docs: DataFrame) -> DataFrame:
    return row_key(docs.select("doc_id", "text")).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "_h", "text")


def _segment_words(docs: DataFrame, contents: DataFrame, window: int) -> DataFrame:
    """The words (as hashes) of each distinct segment, read from its first document."""
    wanted = contents.groupBy(F.col("rep.doc").alias("_d"), F.col("rep._h").alias("_k")).agg(
        F.collect_list(F.struct("rep.start", "n", "mz", "ch", "shard")).alias("parts"))
    wanted = written(wanted, "wanted")
    d = _numbered(docs)
    one = d.join(wanted, (d["doc"] == wanted["_d"]) & (d["_h"] == wanted["_k"])).dropDuplicates(["doc", "_h"])

    def read(batches):
        for batch in batches:
            parts = batch.column("parts")
            for w in words(batch.column("text"), KIND):
                out = []
                for r in range(w.rows):
                    lo = int(w.bound[r])
                    for p in parts[w.first + r].as_py():
                        at = lo + p["start"]
                        out.append((p["shard"], batch.column("doc")[w.first + r].as_py(), p["n"], p["mz"], p["ch"],
                                    w.hashes[at:at + p["n"] + window - 1].tobytes()))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                         pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary())],
                        ["shard", "doc", "n", "mz", "ch", "w"])

    return one.select("doc", "text", "parts").mapInArrow(
        read, "shard int, doc long, n int, mz long, ch long, w binary")


_ANSWER = "n int, mz long, ch long, at array<int>, size array<int>, earliest array<long>"


def _search_shard(window: int):
    def search(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("w")]
        sizes = np.array([len(b) for b in blobs])
        _, symbols = np.unique(np.concatenate(blobs), return_inverse=True)
        texts = np.split(symbols.astype(np.int64) + 1, np.cumsum(sizes)[:-1])
        index = FmIndex(texts, table.column("doc").to_numpy(), window)
        at, size, earliest = [], [], []
        for owners in index.first_owner(texts):
            head = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
            at.append(head.tolist())
            size.append(np.diff(np.concatenate([head, [len(owners)]])).tolist())
            earliest.append(owners[head].tolist())
        return pa.Table.from_arrays(
            [table.column("n"), table.column("mz"), table.column("ch"), pa.array(at, pa.list_(pa.int32())),
             pa.array(size, pa.list_(pa.int32())), pa.array(earliest, pa.list_(pa.int64()))],
            ["n", "mz", "ch", "at", "size", "earliest"])
    return search


def repeated_spans(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                   shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """doc, _h, start, end: word intervals covered by windows that also start in an earlier document."""
    all_segments = written(segments(docs, window, shingle), "segments")
    common = all_segments.groupBy("mz").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("mz")
    shared = written(all_segments.join(common, "mz", "left_semi"), "shared")
    contents = shared.groupBy("mz", "ch", "n").agg(F.min(F.struct("doc", "_h", "start")).alias("rep"))
    contents = written(contents, "contents")
    shards = max(1, -(-contents.count() // shard_segments))
    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("mz"), F.lit(shards)).cast("int"))
    answers = (_segment_words(docs, dealt, window).groupBy("shard").applyInArrow(_search_shard(window), _ANSWER))
    answers = written(answers, "answers")
    met = shared.join(answers, ["mz", "ch", "n"]).select(
        "doc", "_h", "start", F.explode(F.arrays_zip("at", "size", "earliest")).alias("r"))
    begin = F.col("start") + F.col("r.at")
    return met.where(F.col("r.earliest") < F.col("doc")).select(
        "doc", "_h", begin.alias("start"), (begin + F.col("r.size") + (window - 1)).alias("end"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and kept (the text left) if wanted."""
    spans = written(repeated_spans(docs, window, **how), "spans")
    per = written(spans.groupBy(F.col("doc").alias("_d"), F.col("_h").alias("_k")).agg(
        F.collect_list(F.struct("start", "end")).alias("spans")), "per-document")
    d = row_key(docs.select("doc_id", "text")).withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    rows = d.join(per, (d["doc"] == per["_d"]) & (d["_h"] == per["_k"]), "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")

    def strip(batches):
        for batch in batches:
            out = []
            for number, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans"))):
                ws = (text.as_py() or "").encode().split()
                gone = np.zeros(len(ws) + 1, np.int64)
                for s in spans.as_py() or ():
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                kept = b" ".join(ws if keep.all() else [x for x, k in zip(ws, keep.tolist()) if k])
                out.append((number.as_py(), len(ws), int(len(ws) - keep.sum()), hashlib.sha256(kept).hexdigest(),
                            kept.decode() if keep_text else None))
            cols = list(zip(*out))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = rows.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if keep_text else out.drop("kept")
