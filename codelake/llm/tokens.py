"""Token-ID / binary output: token ids in shards compressed by a Re-Pair grammar, readable at any token.

File format: a Parquet table of shards (part, shard, n_tokens, data). ``data`` is little-endian: the mark CLRP1, then
u32 first nonterminal, u32 rules, u32 symbols, u32 documents, u8 bytes a symbol (2 or 4); the rules' left and right
sides (u32 each), the rules' expansion lengths (u32), the tokens before every 1,024th symbol (u64), the documents'
ids (i64; a null id has the flag 1 in the u8 array that follows), their token counts (u64), the symbols.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.store import BROADCAST_ROWS, new_path
from codelake.llm.textkit import return_memory, returning_memory
from codelake.session import ship

MARK = b"CLRP1"
STEP = 1024
SHARD_TOKENS = 1 << 20
GROUP_CHARS = 6_000_000  # texts encoded together
REMEMBERED = 1 << 18  # parts whose ids a worker remembers: some 30 MB
PAIRS = 8192  # pairs that one round replaces at most; the next one takes the rest
TABLE_BITS, _SPREAD = 17, 0x9E3779B1
_SPACE, _LINE, _MARK, _LETTER = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[0x20], _KIND[0x0A] = _SPACE, _LINE
_KIND[list(b".,;:!?")] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
#: Byte-level BPE writes bytes as printable characters: these stay, the others follow from 256 on in their order.
_STAY = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _STAY)}
_HEAD = struct.Struct("<5sIIIIB")
#: A white-space run that goes on after a blank inside it: there texts are encoded whole.
#: Parts (in Arrow's pattern language) without white space but for a blank before them, and without any.
_AFTER_BLANK, _BARE = r"\A [^\s\p{Z}\x{85}\v]+\z", r"\A[^\s\p{Z}\x{85}\v]+\z"
#: A blank and Latin letters: one piece for the library's pattern, which its model may be given as it is.
_WORD = r"\A [A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]+\z"
_WRITTEN = np.array([_BYTES.get(b, b) for b in range(256)], "<u4")
_ODD = re.compile(r"\s (?:\s|\Z)")
#: Bytes that a white-space character may end or begin with in UTF-8; only blanks between two such may be odd.
_ENDS_SPACE, _BEGINS_SPACE = np.zeros(256, bool), np.zeros(256, bool)
_ENDS_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BEGINS_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def repair(ids: np.ndarray, first: int, pairs: int = PAIRS, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): each round counts all neighbouring pairs and replaces the ``pairs`` most frequent ones by new
    nonterminals, left to right without overlap. Rounds end when no pair is replaced often enough to pay for its rule:
    ``least`` times, which is what a rule's twelve bytes hold of symbols. A rule that would make all symbols four bytes
    wide instead of two never pays for that, so none is made then.

    Old pairs only become fewer, so a round looks at the places ``live`` alone: pairs with a symbol of the last round,
    and those that share a slot with a pair that was frequent in it."""
    narrow = first < 1 << 16  # a pair fits in 32 bits then, which sort twice as fast
    half = 16 if narrow else 32
    least = least or 12 // (2 if narrow else 4) + 1
    seq = ids.astype(np.uint32 if narrow else np.uint64)
    kind = seq.dtype.type
    mask = kind((1 << half) - 1)
    rules = np.zeros((0, 2), np.int64)
    slot = lambda x: (x * kind(_SPREAD)) >> kind(2 * half - TABLE_BITS)
    live = np.arange(len(seq) - 1, dtype=np.int32 if len(seq) < 1 << 31 else np.int64)
    while len(live) >= max(least, 2):
        room = min(pairs, (1 << 16) - first - len(rules)) if narrow else pairs
        key = seq[live] << kind(half) | seq[live + 1]
        order = np.sort(key)
        edge = order[np.flatnonzero(order[least - 1 :] == order[: len(order) - least + 1])]  # only pairs of ``least`` occurrences have these
        if not len(edge) or room <= 0:
            break
        begin = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
        often, spare = edge[begin], np.diff(np.append(begin, len(edge)))
        chosen = np.sort(often[np.argsort(-spare, kind="stable")[:room]])
        table = np.zeros(1 << TABLE_BITS, np.int32)  # of two chosen pairs in one slot, one waits for the next round
        table[slot(chosen)] = np.arange(len(chosen))
        place = slot(key)
        rank = table[place]
        hit = np.flatnonzero(chosen[rank] == key)
        at, rank = live[hit], rank[hit]
        start = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        at, rank = at[take], rank[take]
        pays = np.bincount(rank, minlength=len(chosen)) >= least
        if not pays.any():
            break
        chosen, number = chosen[pays], np.cumsum(pays) - 1
        at, rank = at[pays[rank]], number[rank[pays[rank]]]
        seq[at] = (first + len(rules) + rank).astype(kind)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        again = np.zeros(1 << TABLE_BITS, bool)
        again[slot(often)] = True
        open_ = np.zeros(len(seq), bool)
        open_[live[again[place]]] = True
        open_[at] = open_[np.maximum(at - 1, 0)] = True
        seq = seq[keep]
        live = np.flatnonzero(open_[keep][:-1]).astype(live.dtype)
        rules = np.concatenate([rules, np.stack([chosen >> kind(half), chosen & mask], 1).astype(np.int64)])
    return seq, rules


def _blocks(rules: np.ndarray, first: int) -> Iterator[slice]:
    """Consecutive rules that are made of earlier blocks' symbols only."""
    newest = np.maximum.accumulate(rules.max(1)) - first if len(rules) else np.zeros(0, np.int64)
    i = 0
    while i < len(rules):
        j = max(int(np.searchsorted(newest, i)), i + 1)
        yield slice(i, j)
        i = j


def _lengths(rules: np.ndarray, first: int) -> np.ndarray:
    out = np.ones(first + len(rules), np.int64)
    for s in _blocks(rules, first):
        out[first + s.start : first + s.stop] = out[rules[s]].sum(1)
    return out[first:]


def pack(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, first: int) -> bytes:
    symbols, rules = repair(ids, first)
    lengths = _lengths(rules, first)
    each = np.ones(len(symbols), np.int64)
    inner = symbols >= first
    each[inner] = lengths[symbols[inner] - first]
    before = np.cumsum(each) - each
    wide = 2 if first + len(rules) <= 65536 else 4
    head = _HEAD.pack(MARK, first, len(rules), len(symbols), len(doc_ids), wide)
    null = np.array([i is None for i in doc_ids], np.uint8)
    return b"".join([head, rules[:, 0].astype("<u4").tobytes(), rules[:, 1].astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), before[::STEP].astype("<u8").tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), null.tobytes(), sizes.astype("<u8").tobytes(), symbols.astype(f"<u{wide}").tobytes()])


class Shard:
    """A packed shard; ``tokens`` reads any range without expanding the rest."""

    def __init__(self, data: bytes) -> None:
        mark, self.first, rules, symbols, docs, wide = _HEAD.unpack_from(data)
        if mark != MARK:
            raise ValueError("not a packed shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        left, right, self.lengths = take("<u4", rules), take("<u4", rules), take("<u4", rules).astype(np.int64)
        self.before = take("<u8", -(-symbols // STEP)).astype(np.int64)
        ids = take("<i8", docs).tolist()
        self.doc_ids = [None if n else i for i, n in zip(ids, take("u1", docs).tolist(), strict=True)]
        self.sizes = take("<u8", docs).astype(np.int64)
        self.symbols = take(f"<u{wide}", symbols)
        self.size = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.arange(int(self.size.sum()), dtype=np.uint32)
        rule = np.stack([left, right], 1).astype(np.int64)
        for s in _blocks(rule, self.first):
            begin = int(self.begin[self.first + s.start])
            told = self._expand(rule[s].ravel())
            self.flat[begin : begin + len(told)] = told

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        shift = self.begin[symbols] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(size.sum())]

    def tokens(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        total = int(self.sizes.sum())
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.before, start, "right")) - 1
        b = int(np.searchsorted(self.before, stop, "left"))
        out = self._expand(self.symbols[a * STEP : b * STEP])
        return out[start - int(self.before[a]) : stop - int(self.before[a])]

    def document(self, k: int) -> np.ndarray:
        begin = int(self.sizes[:k].sum())
        return self.tokens(begin, begin + int(self.sizes[k]))


def part_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the bytes of joined UTF-8 texts where a part begins that the library's pattern separates too: texts,
    blanks, marks after letters, and line ends (and what follows them) with a letter or mark before and none of white
    space after. Other places are left alone; they only make parts longer."""
    kind = _KIND[data]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])  # kind of the character before, as far as it is sure
    latin = np.flatnonzero(data[:-1] == 0xC3)  # letters of two bytes but the signs of multiplication and division
    sure = np.flatnonzero(latin + 2 < len(data))
    latin = latin[sure]
    letter = (data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)
    before[latin[letter] + 2] = _LETTER
    out = kind == _SPACE
    out |= (kind == _MARK) & (before == _LETTER)
    lines = np.flatnonzero((kind == _LINE) & ((before == _LETTER) | (before == _MARK)))
    lines = lines[lines + 1 < len(data)]
    follows = data[lines + 1]
    lines = lines[(_KIND[follows] == _LETTER) | (_KIND[follows] == _MARK) | (follows == 0xC3)]
    out[lines] = True
    out[lines + 1] = True
    out[0] = True
    out[ends[ends < len(data)]] = True
    return out


class Encoder:
    """Whole texts to ids with the tokenizers library; each different part of a group of texts is encoded once.

    Byte-level BPE never merges across the places that its pattern separates, so a text's ids are those of its parts.
    Arrow numbers the parts of a group of texts. Of the different ones, a blank and Latin letters go to the library's
    model as they are; the others go to the library in two joined texts, cut again at the ids that begin with a blank
    or are a line end. Parts with other white space are encoded one by one; texts where parts do not hold (white-space
    runs around a blank, added tokens) whole.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.parted = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("add_prefix_space") is False and pre.get("use_regex", True)
        self.parted = self.parted and not any(c.isspace() for a in self.added for c in a)
        self.vocabulary = self.tokenizer.get_vocab_size()
        none = np.zeros(0, np.int64)
        self.memory = (pa.array([], pa.large_string()), np.zeros(0, np.uint32), none, none, np.zeros(0, np.int32))
        if self.parted:
            vocabulary = self.tokenizer.get_vocab()
            self.line_end = vocabulary[chr(_BYTES[0x0A])]
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a blank
            self.opens[[i for t, i in vocabulary.items() if t[0] == chr(_BYTES[0x20])]] = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _different(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size): where the ids of each part are in ``ids``. Parts of earlier groups are remembered; beyond
        ``REMEMBERED`` of them, the half that occurred in most groups stays."""
        known, ids, begin, size, seen = self.memory
        place = pc.index_in(parts, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = parts.take(pa.array(new))
            more, at, n = self._new(fresh)
            place[new] = len(known) + np.arange(len(new))
            known, ids, begin, size = pa.concat_arrays([known, fresh]), np.concatenate([ids, more]), np.concatenate([begin, at + len(ids)]), np.concatenate([size, n])
            seen = np.concatenate([seen, np.zeros(len(new), np.int32)])
        seen[place] += 1
        out = ids, begin[place], size[place]
        if len(known) > REMEMBERED:
            stay = np.sort(np.argsort(-seen, kind="stable")[: REMEMBERED // 2])
            known, begin, size, seen = known.take(pa.array(stay)), begin[stay], size[stay], seen[stay] // 2
            after = np.cumsum(size)
            ids = ids[np.repeat(begin - (after - size), size) + np.arange(after[-1])]
            begin = after - size
        self.memory = known, ids, begin, size, seen
        return out

    def _new(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size) of parts that the library encodes now."""
        begin, size, out, filled = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), [], 0
        left = np.ones(len(parts), bool)
        own = pc.match_substring_regex(parts, _WORD).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(own)
        if len(at):
            blank, tokenize = chr(_BYTES[0x20]), self.tokenizer.model.tokenize
            raw = "".join(parts.take(pa.array(at)).to_pylist()).encode()
            words, flat, count = _WRITTEN[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le").split(blank)[1:], [], []
            for w in words:
                found = tokenize(blank + w)
                flat += [t.id for t in found]
                count.append(len(found))
            size[at] = count
            out.append(np.array(flat, np.uint32))
            begin[at] = np.cumsum(size[at]) - size[at]
            left &= ~own
            filled = len(out[0])
        for blank, pattern in (True, _AFTER_BLANK), (False, _BARE):
            own = pc.match_substring_regex(parts, pattern).to_numpy(zero_copy_only=False) & left
            at = np.flatnonzero(own)
            if not len(at):
                continue
            joined = ("" if blank else "\n").join(parts.take(pa.array(at)).to_pylist())
            (ids,) = self._whole([joined])
            cut = np.flatnonzero(self.opens[ids] if blank else ids == self.line_end)
            if len(cut) != len(at) - (not blank):
                continue  # cannot be told apart: these are encoded one by one
            begin[at] = filled + (cut if blank else np.append(0, cut + 1))
            size[at] = filled + np.append(cut[1:] if blank else cut, len(ids)) - begin[at]
            left &= ~own
            out.append(ids)
            filled += len(ids)
        at = np.flatnonzero(left)
        odd = self._whole(parts.take(pa.array(at)).to_pylist())
        size[at] = np.fromiter(map(len, odd), np.int64, len(odd))
        begin[at] = filled + np.cumsum(size[at]) - size[at]
        return np.concatenate([*out, *odd]), begin, size

    def _by_parts(self, data: bytes, ends: np.ndarray) -> list[np.ndarray]:
        if not data:
            return [np.zeros(0, np.uint32)] * len(ends)
        start = np.flatnonzero(part_starts(np.frombuffer(data, np.uint8), ends))
        offsets = np.append(start, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        flat, begin, size = self._different(coded.dictionary)
        codes = coded.indices.to_numpy()
        each = size[codes]
        after = np.cumsum(each)
        place = np.int32 if after[-1] < 1 << 31 and len(flat) < 1 << 31 else np.int64
        ids = flat[np.repeat((begin[codes] - (after - each)).astype(place), each) + np.arange(after[-1], dtype=place)]
        cut = np.append(0, after)[np.searchsorted(start, np.append(0, ends))].tolist()
        return [ids[a:b] for a, b in itertools.pairwise(cut)]

    def _odd(self, texts: list[str], data: bytes, ends: np.ndarray) -> list[int]:
        """The texts whose parts may not hold: with white-space runs around a blank, or with added tokens."""
        if not self.parted:
            return list(range(len(texts)))
        x = np.frombuffer(data, np.uint8)
        blank = np.flatnonzero(x == 0x20)
        last = np.zeros(len(x) + 1, bool)
        last[ends] = True
        blank = blank[_ENDS_SPACE[x[np.maximum(blank - 1, 0)]]]
        blank = blank[last[blank + 1] | _BEGINS_SPACE[x[np.minimum(blank + 1, len(x) - 1)]]]
        maybe = np.unique(np.searchsorted(ends, blank, "right")).tolist()
        out = {i for i in maybe if _ODD.search(texts[i])}
        for a in self.added:
            if a.encode() in data:
                out |= {i for i, t in enumerate(texts) if a in t}
        return sorted(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """u32 ids of each text."""

        def joined(some: list[str]) -> tuple[bytes, np.ndarray]:
            raw = [t.encode() for t in some]
            return b"".join(raw), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))

        data, ends = joined(texts)
        whole = self._odd(texts, data, ends)
        if not whole:
            return self._by_parts(data, ends)
        out = dict(zip(whole, self._whole([texts[i] for i in whole]), strict=True))
        rest = [i for i in range(len(texts)) if i not in out]
        out.update(zip(rest, self._by_parts(*joined([texts[i] for i in rest])), strict=True))
        return [out[i] for i in range(len(texts))]


_encoders: dict[str, Encoder] = {}


def _write(tokenizer_path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = Encoder(tokenizer_path)
        encoder = _encoders[tokenizer_path]
        part, shard = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        total = 0

        def flush() -> pa.RecordBatch:
            sizes = np.fromiter((len(x) + 1 for x in ids), np.int64, len(ids))
            data = pack(np.concatenate([y for x in ids for y in (x, end)]), names, sizes, encoder.vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "n_tokens", "data"])

        for b in (batch.slice(k, 2000) for batch in batches for k in range(0, batch.num_rows, 2000)):
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            group: list[tuple[int | None, str]] = []
            chars = 0
            for i, t in [*rows, (None, None)]:
                last = t is None
                if not last:
                    group.append((i, t))
                    chars += len(t)
                if group and (last or chars > GROUP_CHARS):
                    coded = encoder.encode([t for _, t in group])
                    return_memory()  # a third of the worker's, which the other workers of its executor may need
                    for (name, _), x in zip(group, coded, strict=True):
                        names.append(name)
                        ids.append(x)
                        total += len(x) + 1
                        if total >= shard_tokens:
                            yield flush()
                            ids, names, total, shard = [], [], 0, shard + 1
                    group, chars = [], 0
        if names:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each followed by ``end_id``, in ascending order of id, as packed shards.

    Rows are range-partitioned by id and sorted within partitions; a task fills shards of about ``shard_tokens``
    tokens, so its memory is bounded, and no document is split. Null ids come first; equal ids are ordered by text.
    A null text is the empty one. Extra columns are not written. An empty table gives an empty file table.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(returning_memory(_write(tokenizer_path, end_id, shard_tokens)), "part int, shard int, n_tokens long, data binary").write.parquet(path)


def read_documents(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file table, from its files.

    ``start`` adds up the shards before (within a part by a window over its few shards, over parts by one row a part
    on the driver) and the documents before in the shard."""
    from pyspark.sql import Window

    ship(spark)
    shards = spark.read.schema("part int, shard int, n_tokens long, data binary").parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("shards")).orderBy("part").collect()
    begin, offsets = 0, []
    for r in parts:
        offsets.append((r["part"], begin))
        begin += r["n"]
    first = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = shards.select("part", "shard", F.coalesce(first, F.lit(0)).alias("_in")).join(F.broadcast(spark.createDataFrame(offsets, "part int, _before long")), "part")
    base = base.select("part", "shard", (F.col("_in") + F.col("_before")).alias("start"))
    whole = shards.select("part", "shard", "data").join(F.broadcast(base) if sum(r["shards"] for r in parts) <= BROADCAST_ROWS else base, ["part", "shard"]).select("start", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(data.as_py())
                ids = s.tokens().astype("<u4")
                ends = np.cumsum(s.sizes)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), s.sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start + ends - s.sizes), pa.array(s.sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.mapInArrow(returning_memory(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0, **options) -> DataFrame:
    """``write_tokens`` to ``path`` (a new folder in the shared folder if none is given), then ``read_documents``."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, **options)
    return read_documents(docs.sparkSession, path)
