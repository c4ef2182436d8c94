"""Token ids in wavelet-matrix files.

A shard's token ids are one wavelet matrix: for each bit of an id, from the
highest, a plane holds that bit of every token, and tokens are then stably
parted by it.  With rank on the planes this supports access to any token, counting an
id in any range, and finding its occurrences (select), all from the one file.

File: a header (magic, tokens, planes, documents), the documents' ids and
lengths, the zeros of each plane, and each plane's bits in zstd blocks of
BLOCK_BITS with the ones before each block, so a look-up unpacks one block a plane.
A file is the ``data`` value of one Parquet row, for any store that Spark writes.

Documents are range-partitioned by doc_id (and, among equal ones, by a hash of the text, so a hot id is split) into shards of bounded size; ids are made
by the tokenizers library.  A pre-token of the byte-level pattern never reaches over a single space or line end between two words,
so a text whose words are parted by such only is the sequence of its words, each with the space or line end before it.  Nor does a pre-token
reach from a letter, digit or mark of ASCII (or a letter of LETTER_LEADS) to one of another kind, except from an apostrophe to a letter, so words are
cut there into segments, and a word shares its ids with the same word before a comma.  Each distinct segment is encoded once a worker (until the
worker's memo is full), by the library's model if all its characters are below FIRST_WHOLE and by the whole library else.  Other texts, and
those with an added token of the vocabulary, are encoded whole.  Segments are told apart by 96 bits of hash.

Defined cases: a null text is an empty one and has the end id alone; a null doc_id comes before all others; repeated
documents are stored each, rows of equal doc_id in order of their texts' hashes, then texts, so equal runs give equal files up to copies; a very long text is
in one file, whole; other columns are not read; an empty table makes no file.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brontide.llm import exchange as X
from brontide.llm import textops as T
from brontide.llm.shared import materialize, table

MAGIC = b"BWM2"
BLOCK_BITS = 1 << 16
END_ID = 2
CODEC = pa.Codec("zstd", compression_level=1)
#: Stands for a null doc_id in a file.
NO_ID = -(1 << 63)
#: Bytes of text of a shard: with about 3 bytes a token, some 3 million tokens.
SHARD_BYTES = 8 << 20
#: Segments kept in a worker (and an eighth of their ids) before it starts anew, and bytes of text cut into segments together.
MEMO = 3_000_000
PIECE_BYTES = 1 << 20
#: The byte-level pattern, for words whose characters are in long-settled blocks: below this.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
FIRST_WHOLE = "\u0250"
#: First bytes of the two-byte characters U+00C0 to U+017F and U+0400 to U+047F: letters all, but two marks.
LETTER_LEADS = b"\xc3\xc4\xc5\xd0\xd1"
#: Kinds of bytes: of a letter, a mark or a digit that is sure to be one, or any other (0).
LETTER, MARK, DIGIT = 1, 2, 3
KINDS = np.array([(LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK) if 0x20 < c < 0x7F else 0 for c in range(256)], np.uint8)
LEADS = np.isin(np.arange(256), list(LETTER_LEADS))
#: What stands before a segment: nothing (the text's start or another segment), a space, a line end.
START, SPACE, LINE = 0, 1, 2
LEAD_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Least slots of the memo's table, a power of two, and the share of them in use at which it is doubled: MEMO and a batch fit 1 << 22.
LEAST_SLOTS = 1 << 16
FULL = 0.8
#: Partitions whose files' starts are summed in one window.
STARTS = 4096


def plane_bits(ids: np.ndarray) -> int:
    return max(1, int(ids.max()).bit_length()) if len(ids) else 1


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A file of these tokens; ``lengths`` tells how many belong to each document."""
    planes = plane_bits(np.asarray(ids))
    kind = np.uint16 if planes <= 16 else np.uint32
    now = np.asarray(ids).astype(kind)
    out, zeros, directory = [], [], []
    size = BLOCK_BITS
    high = np.empty(len(now), kind)
    for level in range(planes - 1, -1, -1):
        ones, blocks, low = 0, [], np.empty(len(now), kind)
        # Parted block by block, by places: a mask of random bits costs nearly three times as much.
        for a in range(0, len(now), size):
            part = now[a : a + size]
            bits = (part & kind(1 << level)) != 0
            data = CODEC.compress(np.packbits(bits).tobytes(), asbytes=True)
            blocks.append((ones, len(data)))
            out.append(data)
            up = int(np.count_nonzero(bits))
            if level:  # nothing comes after the lowest plane
                high[ones : ones + up] = part[np.flatnonzero(bits)]
                low[a - ones : a - ones + len(part) - up] = part[np.flatnonzero(~bits)]
            ones += up
        directory.append(blocks)
        zeros.append(len(now) - ones)
        if level:
            low[len(now) - ones :] = high[:ones]
            now = low
    docs = zlib.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes(), 6)
    head = MAGIC + struct.pack("<QIQQ", len(ids), planes, len(doc_ids), len(docs)) + docs + np.array(zeros, "<u8").tobytes()
    head += np.array([x for blocks in directory for x in blocks], "<u8").tobytes()
    return head + b"".join(out)


class WaveletMatrix:
    """Reads a file made by ``build``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.n, self.planes, n_docs, size = struct.unpack_from("<QIQQ", data, 4)
        at = 4 + struct.calcsize("<QIQQ")
        docs = zlib.decompress(data[at : at + size])
        self.doc_ids = np.frombuffer(docs, "<i8", n_docs)
        self.lengths = np.frombuffer(docs, "<u4", n_docs, 8 * n_docs).astype(np.int64)
        at += size
        self.zeros = np.frombuffer(data, "<u8", self.planes, at).astype(np.int64)
        at += 8 * self.planes
        self.blocks = -(-self.n // BLOCK_BITS)
        directory = np.frombuffer(data, "<u8", self.planes * self.blocks * 2, at).reshape(self.planes, self.blocks, 2).astype(np.int64)
        at += 16 * self.planes * self.blocks
        self.ones_before = directory[:, :, 0]
        self.places = at + np.concatenate([[0], np.cumsum(directory[:, :, 1].ravel())])
        self.data = data
        self.block = functools.lru_cache(maxsize=4 * self.planes)(self._block)

    def _block(self, plane: int, number: int) -> np.ndarray:
        k = plane * self.blocks + number
        count = min(BLOCK_BITS, self.n - number * BLOCK_BITS)
        raw = CODEC.decompress(self.data[self.places[k] : self.places[k + 1]], -(-count // 8), asbytes=True)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=count)

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        number, rest = divmod(i, BLOCK_BITS)
        return int(self.ones_before[plane, number]) + int(self.block(plane, number)[:rest].sum())

    def select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        before = self.ones_before[plane] if bit else np.arange(self.blocks) * BLOCK_BITS - self.ones_before[plane]
        number = int(np.searchsorted(before, k, side="right")) - 1
        return number * BLOCK_BITS + int(np.flatnonzero(self.block(plane, number) == bit)[k - int(before[number])])

    def access(self, i: int) -> int:
        value = 0
        for plane in range(self.planes):
            number, rest = divmod(i, BLOCK_BITS)
            bit = int(self.block(plane, number)[rest])
            ones = self.rank1(plane, i)
            i = int(self.zeros[plane]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, first: int, last: int) -> tuple[int, int]:
        for plane in range(self.planes):
            a, b = self.rank1(plane, first), self.rank1(plane, last)
            z = int(self.zeros[plane])
            first, last = (z + a, z + b) if value >> (self.planes - 1 - plane) & 1 else (first - a, last - b)
        return first, last

    def count(self, value: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of an id among the tokens first to last."""
        if value >> self.planes:
            return 0
        last = self.n if last is None else min(last, self.n)
        a, b = self._range(value, min(first, last), last)
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        if k >= self.count(value):
            raise IndexError(k)
        i = self._range(value, 0, self.n)[0] + k
        for plane in range(self.planes - 1, -1, -1):
            bit = value >> (self.planes - 1 - plane) & 1
            i = self.select(plane, bit, i - int(self.zeros[plane]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes are undone from the last to the first."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for plane in range(self.planes - 1, -1, -1):
            z, value = int(self.zeros[plane]), kind(1 << (self.planes - 1 - plane))
            back = np.empty(self.n, kind)
            for number in range(self.blocks):
                bits = self._block(plane, number).view(bool)
                part = back[number * BLOCK_BITS : number * BLOCK_BITS + len(bits)]
                if value == 1:  # nothing is known before the lowest plane
                    part[:] = bits
                    continue
                up, down = np.flatnonzero(bits), np.flatnonzero(~bits)
                ones = int(self.ones_before[plane, number])
                part[up] = now[z + ones : z + ones + len(up)] | value
                part[down] = now[number * BLOCK_BITS - ones : number * BLOCK_BITS - ones + len(down)]
            now = back
        return now.astype(np.uint32)


def byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from U+0100 on."""
    visible = [c for c in range(256) if chr(c).isprintable() and chr(c) != " " and c != 0xAD]
    others = iter(range(256, 512))
    return "".join(chr(c) if c in visible else chr(next(others)) for c in range(256))


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all segments, the row of each, and the bytes without which a segment is one pre-token of letters, marks or digits."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    kinds = KINDS[raw]
    two = np.flatnonzero(LEADS[raw])
    if len(two):
        then = raw[np.minimum(two + 1, len(raw) - 1)]
        two = two[(then & 0xC0 == 0x80) & ((raw[two] != 0xC3) | ((then != 0x97) & (then != 0xB7)))]
        kinds[two] = kinds[two + 1] = LETTER
    word = ~T.SPACE[raw]
    last, here = kinds[:-1], kinds[1:]
    could_contract = (raw[:-1] == 0x27) & (here == LETTER)
    #: Whether a byte goes on with the segment of the one before it; one entry more, for the end.
    on = np.zeros(len(raw) + 1, bool)
    on[1:-1] = word[1:] & word[:-1] & ((last == here) | (last == 0) | (here == 0) | could_contract)
    on[offsets] = False
    starts = np.flatnonzero(word & ~on[:-1])
    ends = np.flatnonzero(word & ~on[1:]) + 1
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    unsure = word & (kinds == 0)
    unsure[1:] |= could_contract & on[1:-1]
    return starts, ends, rows, np.flatnonzero(unsure)


class Encoder:
    """The tokenizers library with a memo of segments.

    ``special_as_text``: the vocabulary's added tokens are ordinary text where a text has their strings.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.added = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        plan = json.loads(self.library.to_str())
        before = plan["pre_tokenizer"] or {}
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids
        #: Whether words can be encoded apart: a byte-level BPE without normalisation.
        self.by_words = plan["normalizer"] is None and (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) == ("ByteLevel", True, False) and plan["model"]["type"] == "BPE"
        of_byte = byte_characters()
        self.characters = {ord(c): "".join(of_byte[b] for b in c.encode()) for c in map(chr, range(ord(FIRST_WHOLE))) if of_byte[ord(c) & 255] != c or ord(c) > 127}
        #: The vocabulary's character of each byte, in UTF-16.
        self.shown = np.array([ord(c) for c in of_byte], "<u2")
        self._forget()

    def _forget(self) -> None:
        #: Ids of known segments, with room behind the ``used`` ones.
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self._make_slots(LEAST_SLOTS)

    def _make_slots(self, n: int) -> None:
        #: An open hash table: a segment's key (0: a free slot), its second hash, and its ids' place and number; a segment of -1 ids can't be encoded apart.
        self.keys, self.checks = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
        self.places, self.sizes = np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.known = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or the free one where it would go."""
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        held = self.keys[at]
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            at[left] = now = (at[left] + 1) & mask
            held = self.keys[now]
            left = left[(held != keys[left]) & (held != 0)]
        return at

    def _put(self, keys: np.ndarray, checks: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> None:
        """Enter distinct keys that the table doesn't have."""
        if self.known + len(keys) > FULL * len(self.keys):
            old = np.flatnonzero(self.keys)
            held = self.keys[old], self.checks[old], self.places[old], self.sizes[old]
            n = len(self.keys)
            while len(old) + len(keys) > FULL * n:
                n *= 2
            self._make_slots(n)
            self._put(*held)
        self.known += len(keys)
        while len(keys):
            at = self._slots(keys)
            self.keys[at] = keys
            won = self.keys[at] == keys  # of those that met in one slot, one
            self.checks[at[won]], self.places[at[won]], self.sizes[at[won]] = checks[won], places[won], sizes[won]
            keys, checks, places, sizes = keys[~won], checks[~won], places[~won], sizes[~won]

    def _append(self, ids: np.ndarray) -> None:
        """Write ids behind the used ones."""
        if self.used + len(ids) > len(self.ids):
            more = np.zeros(max(2 * len(self.ids), self.used + len(ids)), np.uint32)
            more[: self.used] = self.ids[: self.used]
            self.ids = more
        self.ids[self.used : self.used + len(ids)] = ids

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_ids(self, piece: str) -> list[int]:
        """Ids of a pre-token of settled characters."""
        return [t.id for t in self.model.tokenize(piece.translate(self.characters))]

    def segment_ids(self, word: str, lead: int) -> list[int] | None:
        """Ids of a segment with what stands before it; None if it holds white space, which could join with what is around."""
        if not word.isprintable() and any(c.isspace() for c in word):
            return None
        if max(word) < FIRST_WHOLE:
            found = [i for piece in PATTERN.findall(f" {word}" if lead == SPACE else word) for i in self._model_ids(piece)]
        else:
            found = self.library.encode(f" {word}" if lead == SPACE else word, add_special_tokens=False).ids
        return self.line_end + found if lead == LINE else found

    def _learn(self, keys, checks, raw, data, starts, ends, lead, unsure) -> None:
        """Put new segments into the memo."""
        model, line_end = self.model.tokenize, self.line_end
        shown = self.shown[raw].tobytes().decode("utf-16-le")
        sure = np.searchsorted(unsure, starts) == np.searchsorted(unsure, ends)
        flat, tops, apart = [], [], []
        for a, b, before, one in zip(starts.tolist(), ends.tolist(), lead.tolist(), sure.tolist(), strict=True):
            if one:
                if before == LINE:
                    flat += line_end
                flat += [t.id for t in model(shown[a - 1 if before == SPACE else a : b])]
            else:
                ids = self.segment_ids(data[a:b].decode(), before)
                if ids is None:
                    apart.append(len(tops))
                else:
                    flat += ids
            tops.append(len(flat))
        places = np.array([0, *tops], np.int64)
        sizes = np.diff(places).astype(np.int32)
        sizes[apart] = -1
        self._append(np.array(flat, np.uint32))
        self._put(keys, checks, self.used + places[:-1], sizes)
        self.used += len(flat)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each), of texts as UTF-8 bytes and their offsets; ``end`` closes each text."""
        n = len(offsets) - 1
        starts, ends, rows, unsure = segments(raw, offsets)
        numbers = np.bincount(rows, minlength=n)
        first = np.ones(len(starts), bool)
        first[1:] = rows[1:] != rows[:-1]
        gap = starts - np.where(first, offsets[rows], np.concatenate([[0], ends[:-1]])) if len(starts) else starts
        before = raw[np.maximum(starts - 1, 0)]
        lead = np.where(gap == 0, START, np.where(before == 0x20, SPACE, LINE))
        odd = (gap > 1) | ((gap == 1) & (before != 0x20) & (before != 0x0A))
        plain = np.full(n, self.by_words)
        plain[rows[odd]] = False
        lasts = offsets[:-1].copy()
        lasts[rows] = ends
        plain[lasts != offsets[1:]] = False  # white space at the end
        data = raw.tobytes()
        if any(t.encode() in data for t in self.added):
            for i in range(n):
                plain[i] &= not any(t.encode() in data[offsets[i] : offsets[i + 1]] for t in self.added)
        here = plain[rows]
        places, sizes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
        if here.all() and len(here):
            places, sizes = self._known(raw, data, starts, ends, lead, unsure)
        elif here.any():
            places[here], sizes[here] = self._known(raw, data, starts[here], ends[here], lead[here], unsure)
        plain[rows[here & (sizes < 0)]] = False
        # A text is its segments' ids, or one run of ids of its own; then the end.
        other = np.flatnonzero(~plain)
        runs = self.whole([data[offsets[i] : offsets[i + 1]].decode() for i in other])
        tail = np.concatenate([*runs, np.array([] if end is None else [end])]).astype(np.uint32)
        run_sizes = np.array([len(r) for r in runs], np.int64)
        self._append(tail)
        firsts = np.concatenate([[0], np.cumsum(np.where(plain, numbers, 1) + (end is not None))])
        place, size = np.empty(firsts[-1], np.int64), np.empty(firsts[-1], np.int64)
        at = np.arange(len(rows)) + np.repeat(firsts[:-1] - (np.cumsum(numbers) - numbers), numbers)
        if len(other):
            here = plain[rows]
            at, places, sizes = at[here], places[here], sizes[here]
        place[at], size[at] = places, sizes
        place[firsts[other]], size[firsts[other]] = self.used + np.cumsum(run_sizes) - run_sizes, run_sizes
        if end is not None:
            place[firsts[1:] - 1], size[firsts[1:] - 1] = self.used + len(tail) - 1, 1
        ends = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(place - ends[:-1], size) + np.arange(ends[-1])
        return self.ids[index], np.diff(ends[firsts])

    def _known(self, raw, data, starts, ends, lead, unsure) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the ids of each segment, learning those that are new."""
        if self.known > MEMO or self.used > 8 * MEMO:
            self._forget()
        keys = np.maximum(T.word_hashes(raw, starts, ends) + lead.astype(np.uint64) * LEAD_MUL, np.uint64(1))
        checks = (T.word_hashes(raw, starts, ends, 1) >> np.uint64(32)).astype(np.uint32)
        at = self._slots(keys)
        new = np.flatnonzero(self.keys[at] == 0)
        if len(new):
            new = new[np.unique(keys[new], return_index=True)[1]]
            self._learn(keys[new], checks[new], raw, data, starts[new], ends[new], lead[new], unsure)
            at = self._slots(keys)
        return self.places[at], np.where(self.checks[at] == checks, self.sizes[at], -1)  # another segment of the same key: not apart


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None, special_as_text: bool = False) -> Encoder:
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"), special_as_text)


def _file_rows(batches, path, special_as_text):
    """One file for each run of about SHARD_BYTES of a sorted partition."""
    coder = encoder(path, special_as_text)
    docs: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    size = count = 0
    at = TaskContext.get().partitionId()

    def flush():
        tokens = np.concatenate(ids)
        file = build(tokens, np.concatenate(docs), np.concatenate(lengths))
        return pa.RecordBatch.from_arrays([pa.array([at << 32 | count], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([file], pa.binary())], names=["file", "n_tokens", "data"])

    for batch in batches:
        raw, offsets = T.string_buffers(batch.column(1))
        known = batch.column(0)
        known = np.where(known.is_null(), NO_ID, known.fill_null(0)).astype(np.int64)
        for a, b in T.pieces(offsets, PIECE_BYTES):
            found, sizes = coder.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], END_ID)
            docs.append(known[a:b])
            ids.append(found)
            lengths.append(sizes)
            size += int(offsets[b] - offsets[a])
            if size >= SHARD_BYTES:
                yield flush()
                docs, ids, lengths, size, count = [], [], [], 0, count + 1
    if docs:
        yield flush()


def write_files(docs: DataFrame, path: str | None = None, special_as_text: bool = False) -> DataFrame:
    """(file, n_tokens, data): the files, in the shared folder; ascending file numbers hold ascending doc_ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = X.shard_count(X.text_bytes(docs), SHARD_BYTES)
    place = F.xxhash64("text").alias("place")
    dealt = docs.select("doc_id", "text", place).repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place", "text")
    return materialize(dealt.select("doc_id", "text").mapInArrow(lambda batches: _file_rows(batches, path, special_as_text), "file long, n_tokens long, data binary"), "token-files")


def file_starts(files: DataFrame) -> DataFrame:
    """(file, before): the tokens of all files before each, by sums of STARTS partitions and then within them."""
    sizes = files.select("file", "n_tokens", F.expr(f"shiftright(file, 32) div {STARTS}").alias("part"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for STARTS * SHARD_BYTES of text.
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").select("file", (F.col("start") + F.col("within")).alias("before"))


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                matrix = WaveletMatrix(r["data"])
                data = memoryview(matrix.tokens().astype("<u4").tobytes())
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(matrix.doc_ids, mask=matrix.doc_ids == NO_ID), pa.array(np.full(len(ends), r["file"], np.int64)), pa.array(starts), pa.array(matrix.lengths), pa.array(crcs, pa.int64())], names=["doc_id", "file", "inner", "n_tokens", "ids_crc32"])

    found = files.select("file", "data").mapInArrow(run, "doc_id long, file long, inner long, n_tokens long, ids_crc32 long")
    return found.join(file_starts(files), "file").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op6_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(table(spark, sf_dir, "documents")))
