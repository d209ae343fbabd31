"""Byte-level BPE over a minimal acyclic transducer lexicon.

Encoding counts the words (pre-tokens) of the whole corpus, takes the `lexicon_words` most
frequent, merges them exactly once, and compiles them into the smallest acyclic automaton: equal
suffixes share their states, and every transition carries the number of words that sort before it,
so that the sum along a word's path is its number and points at its ids. The file lies in the
shared folder; Spark hands it to every executor, where it is memory-mapped, so the workers of a
machine share its pages. Words that the automaton does not accept are merged exactly by rank.

A worker cuts a column of texts into segments on its bytes and looks at the distinct ones only. It
remembers short segments and words, in a memo of bounded size; new words walk through the automaton
together, one byte of all of them at a time.

Decoding turns ids back into bytes and reads them as UTF-8.

Defined results: a null or empty text has no ids and decodes to the empty text; ids outside the
vocabulary raise an error; an empty table gives an empty result; further columns are kept, a column
with the result's name is replaced.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import new_path, staged, text_of
from colloquy.llm.segments import PRETOKENS, SPECIAL, as_strings, cut, pieces

LEXICON_WORDS = 131_072
LONGEST = 48  # bytes of a word in the lexicon
NO_RANK = (1 << 31) - 1


class Vocabulary:
    """Merge ranks and the bytes of each id, from a byte-level BPE file."""

    def __init__(self, file: str):
        import regex

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others
        # for the code points from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.find_words = regex.compile(PRETOKENS).findall
        self._index_pairs()

    def as_array(self) -> pa.Array:
        """The bytes of each id."""
        return pa.array(self.bytes, pa.large_binary())

    def words(self, segment: str) -> list[str]:
        """A segment's pre-tokens."""
        if segment.isalpha() or segment[:1] == " " and segment[1:].isalpha():
            return [segment]
        return self.find_words(segment)

    def _index_pairs(self) -> None:
        """An open-addressing table from a pair of ids to its rank and the id it makes."""
        self.bits = (2 * len(self.merges)).bit_length() + 1
        keys = np.array([a << 32 | b for a, b in self.merges] or [0], np.int64)[: len(self.merges)]
        made = np.array([*self.merges.values()], np.int64).reshape(-1, 2)
        self.pair = np.full(1 << self.bits, -1, np.int64)
        self.pair_rank = np.full(1 << self.bits, NO_RANK, np.int32)
        self.made = made[np.argsort(made[:, 0]), 1]  # by rank
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.pair[slot[left]] == -1
            self.pair[slot[left[free]]] = keys[left[free]]
            won = self.pair[slot[left]] == keys[left]
            self.pair_rank[slot[left[won]]] = made[left[won], 0]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where none merges; -1 stands for no id."""
        keys = np.ascontiguousarray(a << 32 | b).ravel()
        slot = self._slot(keys)
        out = np.full(len(keys), NO_RANK, np.int32)
        left = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        while len(left):
            held = self.pair[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.pair_rank[slot[left[hit]]]
            left = left[~hit & (held != -1)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out.reshape(a.shape)

    def merge_all(self, words: list[bytes], at_once: int = 4096) -> list[bytes]:
        """The ids of many words as little-endian 32-bit; short words merge side by side."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > LONGEST:
            i = order.pop()
            out[i] = np.array(self.merge(words[i]), "<i4").tobytes()
        for first in range(0, len(order), at_once):
            part = order[first : first + at_once]
            width = max(1, len(words[part[-1]]))
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
            size = np.array([len(words[i]) for i in part])
            ids = np.where(np.arange(width) < size[:, None], np.array(self.byte_id)[raw], -1)
            ids = np.hstack([ids, np.full((len(part), 1), -1)])
            self._merge_matrix(ids)
            flat, ends = ids[ids >= 0].astype("<i4").tobytes(), np.cumsum((ids >= 0).sum(1)).tolist()
            for i, a, b in zip(part, [0, *ends], ends):
                out[i] = flat[4 * a : 4 * b]
        return out

    def _merge_matrix(self, ids: np.ndarray) -> None:
        """Merge every row as `merge` does; rows end in -1. Rows still merging lose one place a step."""
        rank = np.full(ids.shape, NO_RANK, np.int32)  # of the pair that begins at each place
        rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        rows, now = np.arange(len(ids)), ids.copy()
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            go = best < NO_RANK
            if not go.all():
                ids[rows[~go], : now.shape[1]] = now[~go]
                ids[rows[~go], now.shape[1] :] = -1
                rows, at, best, now, rank = rows[go], at[go], best[go], now[go], rank[go]
            n, made, width = np.arange(len(rows)), self.made[best], now.shape[1] - 1
            keep = np.ones(now.shape, bool)
            keep[n, at + 1] = False
            now, rank = now[keep].reshape(-1, width), rank[keep].reshape(-1, width)
            now[n, at] = made
            back = np.flatnonzero(at > 0)
            found = self.ranks(np.r_[made, now[back, at[back] - 1]],
                               np.r_[now[n, np.minimum(at + 1, width - 1)], made[back]])
            rank[n, at], rank[back, at[back] - 1] = found[: len(n)], found[len(n) :]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: again and again the leftmost pair of the lowest rank."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 40:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            found = [(merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [merges[ids[i], ids[i + 1]][1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = new, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in merges:
                    heapq.heappush(heap, (*merges[p], k, p))
        return [x for x in ids if x is not None]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal automaton of the words, numbered in sorted order, and their ids, as one block."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)), targets before sources

    def finish(node: list) -> int:
        key = (node[0], tuple((b, t) for b, t in node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    words = sorted(entries)
    for word in [*words, b""]:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1][-1][1] = finish(node)
        for b in word[common:]:
            path[-1][1].append([b, -1])
            path.append([False, []])
        if word:
            path[-1][0] = True
        last = word
    root = finish(path[0])
    below = np.zeros(len(states), np.int64)  # words accepted from each state
    for s, (final, arcs) in enumerate(states):
        below[s] = final + sum(below[t] for _, t in arcs)
    arcs = sorted((s * 256 + b, t, int(final) + sum(int(below[u]) for _, u in out[:i]))
                  for s, (final, out) in enumerate(states) for i, (b, t) in enumerate(out))
    key, target, skip = (np.array([a[i] for a in arcs], "<i8") for i in range(3))
    final = np.array([s[0] for s in states], "<i8")
    ends = np.cumsum([0, *(len(entries[w]) for w in words)]).astype("<i8")
    ids = np.array([i for w in words for i in entries[w]], "<i4")
    head = np.array([root, len(arcs), len(states), len(words)], "<i8")
    return b"".join(x.tobytes() for x in (head, key, target, skip, final, ends, ids))


class Lexicon:
    """The compiled automaton, mapped from its file."""

    def __init__(self, block: np.ndarray):
        block = np.asarray(block)
        self.root, arcs, states, words = (int(x) for x in block[:32].view("<i8"))
        cuts = 8 * np.cumsum([4, arcs, arcs, arcs, states, words + 1])
        self.key, self.target, self.skip, self.final, self.ends = (
            block[a:b].view("<i8") for a, b in zip(cuts, cuts[1:]))
        self.ids = block[cuts[-1] :].view("<i4")

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, "r"))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1 where the automaton does not accept it."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max(initial=0))
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        state = np.where(size > 0, self.root, -1)
        number = np.zeros(len(words), np.int64)
        for at in range(width if len(self.key) else 0):
            go = np.flatnonzero((size > at) & (state >= 0))
            wanted = state[go] * 256 + letters[go, at]
            arc = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            found = self.key[arc] == wanted
            state[go] = np.where(found, self.target[arc], -1)
            number[go] += np.where(found, self.skip[arc], 0)
        ok = state >= 0
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok & (len(self.key) > 0), number, -1)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(file: str) -> Vocabulary:
    """The worker's copy."""
    if file not in _vocabularies:
        _vocabularies[file] = Vocabulary(file)
    return _vocabularies[file]


class Encoder:
    """Segments to ids: the lexicon first, exact merging for the rest."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None, most: int = 900_000):
        self.vocab, self.lexicon, self.most = vocab, lexicon, most
        self.marks = {s: np.array([i], "<i4").tobytes() for s, i in vocab.special.items() if s == SPECIAL}
        self.memo: dict[str, bytes] = dict(self.marks)  # of short segments and words

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words as little-endian 32-bit; they walk the automaton together."""
        raw = [w.encode() for w in words]
        ids: list[bytes | None] = [None] * len(raw)
        if self.lexicon is not None:
            short = [i for i, w in enumerate(raw) if len(w) <= LONGEST]
            number = self.lexicon.numbers([raw[i] for i in short])
            found = np.flatnonzero(number >= 0)
            begin, end = (self.lexicon.ends[number[found] + i].tolist() for i in (0, 1))
            for i, a, b in zip(found.tolist(), begin, end):
                ids[short[i]] = self.lexicon.ids[a:b].tobytes()
        unseen = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(unseen, self.vocab.merge_all([raw[i] for i in unseen])):
            ids[i] = x
        return dict(zip(words, ids))

    def ids_of(self, segments: list[str]) -> list[bytes]:
        """Ids of distinct segments. A word alone is its own only word, so one memo serves both."""
        memo = self.memo
        out = list(map(memo.get, segments))
        new = [i for i, x in enumerate(out) if x is None]
        if not new:
            return out
        groups = [self.vocab.words(segments[i]) for i in new]
        known = self.word_ids(list(set().union(*groups).difference(memo)))
        for i, group in zip(new, groups):
            out[i] = b"".join([known.get(w) or memo[w] for w in group])
        if len(memo) + len(known) + len(new) > self.most:
            memo.clear()
            memo.update(self.marks)
        memo.update((w, x) for w, x in known.items() if len(w) <= LONGEST)
        memo.update((segments[i], out[i]) for i in new if len(segments[i]) <= LONGEST)
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end. Only distinct segments pass Python."""
        segments, first = cut(texts)
        coded = segments.dictionary_encode()
        ids = pa.array(self.ids_of(as_strings(coded.dictionary)), pa.large_binary()).take(coded.indices)
        if not len(ids):
            return np.zeros(0, "<i4"), np.zeros(len(texts), np.int64)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] // 4
        return np.frombuffer(ids.buffers()[2], "<i4")[: ends[-1]], ends[first[1:]]


_encoders: dict[tuple, Encoder] = {}


def encoder(tokenizer_file: str, lexicon: str | None = None) -> Encoder:
    """The worker's encoder, whose memo serves its later tasks too; only the latest is kept."""
    key = (tokenizer_file, lexicon)
    if key not in _encoders:
        _encoders.clear()
        mapped = Lexicon.mapped(SparkFiles.get(lexicon)) if lexicon else None
        _encoders[key] = Encoder(vocabulary(tokenizer_file), mapped)
    return _encoders[key]


def word_counts(docs: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """(word, n) of the whole corpus. Segments are counted first, words once per distinct segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = vocabulary(tokenizer_file).words

        def out(segments: Counter) -> pa.RecordBatch:
            words: Counter = Counter()
            for s, n in segments.items():
                for w in words_of(s) if s != SPECIAL else ():
                    words[w] += n
            raw = [w.encode() for w in words]
            short = [i for i, w in enumerate(raw) if len(w) <= LONGEST]
            n = list(words.values())
            return pa.RecordBatch.from_arrays(
                [pa.array([raw[i] for i in short], pa.binary()), pa.array([n[i] for i in short], pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        held = 0
        for batch in batches:
            for texts in pieces(batch.column(0)):
                counts = cut(texts)[0].value_counts()
                for s, n in zip(as_strings(counts.field(0)), counts.field(1).to_numpy().tolist()):
                    if s not in seen:
                        held += len(s)
                    seen[s] += n
                if held > 4_000_000:
                    yield out(seen)
                    seen, held = Counter(), 0
        yield out(seen)

    rows = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_file: str, text_col: str = "text",
                  lexicon_words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words; returns the file's name among Spark's files."""
    spark = docs.sparkSession

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = vocabulary(tokenizer_file).merge_all
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in merge(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    top = word_counts(docs, tokenizer_file, text_col).orderBy(F.desc("n"), "word").limit(lexicon_words)
    top = staged(top.select("word").mapInArrow(ids, "word binary, ids array<int>"), "lexicon-words")
    block = compile_lexicon({bytes(r.word): list(r.ids) for r in top.toLocalIterator()})
    return share(spark, block, "lexicon")


def share(spark: SparkSession, block: bytes, label: str) -> str:
    """Put bytes into the shared folder and have Spark hand them to executors, also to later ones."""
    path = new_path(spark, label)
    name = f"{label}-{path.split('/')[-2]}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(block))
    stream.close()
    spark.sparkContext.addFile(f"{path}/{name}")
    return name


def encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text",
           lexicon_words: int = LEXICON_WORDS, lexicon: str | None = None) -> DataFrame:
    """docs with their text replaced by `ids array<int>`."""
    lexicon = lexicon or build_lexicon(docs, tokenizer_file, text_col, lexicon_words)
    others = [c for c in docs.columns if c != text_col and c.lower() != "ids"]
    rows = docs.select(text_of(text_col).alias(text_col), *[F.col(f"`{c}`") for c in others])
    schema = T.StructType([*rows.schema[1:], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_file, lexicon)
        for whole in batches:
            at = 0
            for texts in pieces(whole.column(0)):
                batch = whole.slice(at, len(texts))
                at += len(texts)
                flat, ends = coder.encode_column(texts)
                column = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], column], [*batch.schema.names[1:], "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with a further column: the text of its ids, invalid UTF-8 read as U+FFFD."""
    encoded = encoded.drop(text_col)  # of the same name, in any case
    schema = T.StructType([*encoded.schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(tokenizer_file).as_array()
        for whole in batches:
            at = whole.schema.names.index(ids_col)
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                column = batch.column(at)
                found = tokens.take(column.flatten())
                ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, int)
                data = memoryview(found.buffers()[2]) if len(found) else b""
                cuts = ends[np.r_[0, column.value_lengths().fill_null(0).to_numpy().cumsum()]].tolist()
                texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)
