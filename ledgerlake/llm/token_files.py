"""Token ids in Arrow files of equal-length sequences, readable at random without copying.

``encode_documents`` sorts documents by number over range partitions. Each task encodes its documents
and streams them into two Arrow files of its shard in a shared folder:

- ``*.tokens.arrow``: record batches of two fixed-size-list columns, ``input_ids`` (uint16, or uint32 for
  larger vocabularies) and ``attention_mask`` (1 for a token, 0 for padding), ``seq_len`` entries each.
  Ids of consecutive documents follow each other without gaps; only a shard's last sequence is padded.
- ``*.docs.arrow``: ``doc_id``, ``start`` (the document's first id, counted within the shard) and
  ``n_tokens``, in order.

A task attempt writes under a name of its own and reports it in the manifest, which Spark commits; files of
lost or repeated attempts are never named there. ``TokenShard`` maps a shard's file into memory and gives any
sequence as a view of it.

Null texts are empty and yield the end id only; null numbers come first. Rows that repeat a number are
ordered by a hash of their text (equal rows are interchangeable). An empty table yields no shard.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import new_folder, written

SEQ_LEN = 2048
END_ID = 1
MANIFEST = "shard int, name string, n_docs long, n_tokens long, n_sequences long"
# What an encoder remembers, in bytes (an entry counts twice its length and ``ENTRY_BYTES``, more than it takes); longer words are forgotten after a call.
CACHE_BYTES = 160 << 20
ENTRY_BYTES = 160
LONGEST_WORD = 256

# A call encodes documents of so many bytes of text, or a single longer one.
CHUNK_BYTES = 4 << 20

# What is not plain in a word, and how the word tokenizer's own pattern cuts lower-cased plain words.
_ODD = r"[^!-~À-ÖØ-öø-ÿ]"
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"
_SAMPLE = "It's the Éclair, 42 times: don't  (stop)!\n“Ναὶς” e\u0301te\u0301 文字٣x \x1c a\xa0b \u0301\u0327c"


class Encoder:
    """Texts to ids with a ``tokenizers`` file.

    A tokenizer that lower-cases, drops white space and cuts at word ends encodes each word alone, so words are
    encoded once and remembered, and those of plain Latin characters are made of pieces that are remembered too (a
    cache bounded by bytes). Words are cut, told apart and put together as Arrow columns; only distinct ones are looked
    up one by one. Any text with a special token's name, and every text of another kind of tokenizer, goes through
    ``encode`` whole. Both ways give the same ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # Pieces are lower-cased and cut already: encode them without the normalizer and the pattern.
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Ids that stand at a piece's end only.
        vocab, suffix = self.bare.get_vocab(), getattr(self.bare.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix) and t not in self.special]] = True
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held, self.long = 0, []
        self.by_word = b"".join(self._by_word(pa.array([_SAMPLE], pa.large_string()))) == self._whole(_SAMPLE)
        self._clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _by_word(self, texts: pa.Array) -> list[bytes]:
        return self._joined(pc.ascii_split_whitespace(texts), self.words, self._spell_words)

    def _joined(self, lists: pa.ListArray, known: dict[str, bytes],
                spell: Callable[[pa.Array], list[bytes]]) -> list[bytes]:
        """The ids of each list's strings behind each other; strings that are not ``known`` are spelled and remembered."""
        found = lists.flatten().dictionary_encode()
        keys = _objects(found.dictionary)
        got = list(map(known.get, keys))
        fresh = [ids is None and k != "" for ids, k in zip(got, keys)]
        if any(fresh):
            new = found.dictionary.filter(pa.array(fresh))
            names, spelled = _objects(new), spell(new)
            cost = 2 * sum(map(len, names)) + ENTRY_BYTES * len(names)
            if self.held + cost > CACHE_BYTES:  # ``got`` and ``spelled`` have what this call needs
                self._clear()
            known.update(zip(names, spelled, strict=True))
            self.held += cost
            self.long += [(known, k) for k in names if len(k) > LONGEST_WORD]
            rest = iter(spelled)
            got = [next(rest) if f else ids for f, ids in zip(fresh, got)]
        ids = pa.array(got, pa.large_binary()).take(found.indices)
        # The taken strings lie behind each other in one buffer: a list's ids reach from its first string to its last.
        _, ends, data = ids.buffers()
        places = lists.offsets.to_numpy()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1)[places - places[0]]
        return _objects(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), data]))

    def _spell_words(self, words: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(words, _ODD)
        lower = pc.utf8_lower(words.filter(pc.invert(odd)))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, _PIECE, r"\0 "))
        plain, whole = iter(self._joined(cut, self.pieces, self._spell_pieces)), iter(words.filter(odd).to_pylist())
        return [self._whole(next(whole)) if o else next(plain) for o in odd.to_pylist()]

    def _spell_pieces(self, pieces: pa.Array) -> list[bytes]:
        out, size = [], self.dtype.itemsize
        for k in range(0, len(pieces), 2000):
            some = _objects(pieces.slice(k, 2000))
            ids = np.array(self.bare.encode(" ".join(some), add_special_tokens=False).ids, self.dtype)
            ends = (np.flatnonzero(self.last[ids]) + 1) * size
            if len(ends) == len(some):
                raw, ends = ids.tobytes(), ends.tolist()
                out += [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]
            else:  # pieces' ends do not show in the ids
                out += [np.array(self.bare.encode(p, add_special_tokens=False).ids, self.dtype).tobytes() for p in some]
        return out

    def _clear(self) -> None:
        self.words.clear()
        self.pieces.clear()
        self.held, self.long = 0, []

    def _forget(self) -> None:
        """Drop the very long words of the call before, and everything once it is too much."""
        for known, x in self.long:
            known.pop(x, None)
            self.held -= 2 * len(x) + ENTRY_BYTES
        self.long = []
        if self.held > CACHE_BYTES:
            self._clear()

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Ids of each text (null: none) as little-endian bytes."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        whole = np.full(len(texts), not self.by_word)
        for name in self.special:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        self._forget()
        by_word = iter(self._by_word(texts.filter(pa.array(~whole))))
        for t, w in zip(texts, whole.tolist()):
            yield self._whole(t.as_py()) if w else next(by_word)


def _objects(strings: pa.Array) -> list:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of stretches that end within ``most`` bytes of each other."""
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1).tolist()
    yield from ((lo, hi - lo) for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]) if hi > lo)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder)
                                          if "://" in folder or folder.startswith("file:") else folder)


def _open(folder: str, name: str) -> pa.NativeFile:
    fs, root = _place(folder)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return pa.memory_map(f"{root}/{name}")
    return fs.open_input_file(f"{root}/{name}")


class _ShardWriter:
    """Packs ids into sequences and writes a batch whenever ``batch`` sequences are full."""

    def __init__(self, folder: str, name: str, seq_len: int, dtype: np.dtype, batch: int = 256):
        fs, root = _place(folder)
        fs.create_dir(root, recursive=True)
        self.ids = pa.list_(pa.uint16() if dtype.itemsize == 2 else pa.uint32(), seq_len)
        self.mask = pa.list_(pa.bool_(), seq_len)
        self.schema = pa.schema([("input_ids", self.ids), ("attention_mask", self.mask)])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [fs.open_output_stream(f"{root}/{name}.{part}.arrow") for part in ("tokens", "docs")]
        self.tokens, self.docs = (pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, self.index)))
        self.seq_len, self.dtype, self.batch = seq_len, dtype, batch
        self.rest, self.held, self.rows = [], 0, []
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.rows.append((doc_id, self.n_tokens, n))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + n
        self.rest.append(ids)
        self.held += n
        if self.held >= self.batch * self.seq_len:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.rest), self.dtype)
        n = -(-len(flat) // self.seq_len) if last else len(flat) // self.seq_len
        use = flat[:n * self.seq_len]
        pad = n * self.seq_len - len(use)
        self.rest, self.held = [flat[len(use):].tobytes()], len(flat) - len(use)
        if n:
            full = np.concatenate([use, np.zeros(pad, self.dtype)]) if pad else use
            mask = np.ones(len(full), bool)
            mask[len(use):] = False
            for lo in range(0, n, self.batch):
                at = slice(lo * self.seq_len, (lo + self.batch) * self.seq_len)
                self.tokens.write_batch(pa.record_batch([
                    pa.FixedSizeListArray.from_arrays(pa.array(full[at]), type=self.ids),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask[at]), type=self.mask)], schema=self.schema))
            self.n_sequences += n
        if self.rows:
            self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows)],
                                                  schema=self.index))
            self.rows = []

    def close(self) -> None:
        self._flush(True)
        for w in (self.tokens, self.docs, *self.files):
            w.close()


class TokenShard:
    """Random access to one shard; on a local or mounted folder the arrays are views of the mapped file."""

    def __init__(self, folder: str, name: str):
        self.tokens = pa.ipc.open_file(_open(folder, f"{name}.tokens.arrow"))
        self.docs = pa.ipc.open_file(_open(folder, f"{name}.docs.arrow"))
        self.seq_len = self.tokens.schema.field("input_ids").type.list_size
        self.per_batch = self.tokens.get_batch(0).num_rows if self.tokens.num_record_batches else 1
        sizes = [self.tokens.get_batch(i).num_rows for i in range(self.tokens.num_record_batches)]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.first[-1])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids of sequence ``i`` (a view) and its mask."""
        k = int(np.searchsorted(self.first, i, "right")) - 1
        b, row = self.tokens.get_batch(k), i - int(self.first[k])
        ids = b.column(0).flatten().to_numpy(zero_copy_only=True)
        return (ids[row * self.seq_len:(row + 1) * self.seq_len],
                b.column(1).flatten().slice(row * self.seq_len, self.seq_len))

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard."""
        parts, at, end = [], start, start + n
        while at < end:
            k = int(np.searchsorted(self.first, at // self.seq_len, "right")) - 1
            base, stop = int(self.first[k]) * self.seq_len, int(self.first[k + 1]) * self.seq_len
            flat = self.tokens.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            parts.append(flat[at - base:min(end, stop) - base])
            at = min(end, stop)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for i in range(self.docs.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.docs.get_batch(i).columns))


def encode_documents(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID,
                     seq_len: int = SEQ_LEN) -> tuple[str, DataFrame]:
    """Write the token files of ``docs`` (doc_id, text) below ``folder``; returns the folder and the manifest."""
    folder = folder or new_folder(docs.sparkSession, "tokens")

    def write(batches):
        writer, shard = None, TaskContext.get().partitionId()
        name = f"shard-{shard:07d}-{uuid.uuid4().hex[:8]}"
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            writer = writer or _ShardWriter(folder, name, seq_len, enc.dtype)
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, n in _chunks(sizes, CHUNK_BYTES):
                numbers, texts = b.slice(lo, n).columns
                for number, ids in zip(numbers.to_pylist(), enc.encode(texts)):
                    writer.add(number, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": [writer.n_docs],
                "n_tokens": [writer.n_tokens], "n_sequences": [writer.n_sequences]})

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h")
               .sortWithinPartitions("doc_id", "_h").select("doc_id", "text"))
    return folder, written(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_documents(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    def read(batches):
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist()):
                shard, out = TokenShard(folder, name), []
                for number, start, n in shard.documents():
                    crc = zlib.crc32(shard.ids(start, n).astype("<u4").tobytes())
                    out.append((number, base + start, n, crc))
                    if len(out) == 10_000:
                        yield _doc_rows(out)
                        out = []
                if out:
                    yield _doc_rows(out)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    bases = manifest.select("shard", "name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    spread = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return bases.repartition(spread, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _doc_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                      ["doc_id", "start", "n_tokens", "ids_crc32"])
