"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens. It starts with one state that loops on every byte, and each merge (u, v -> w), in order of
rank, applies a gadget: the target of u loses its arc v, w enters with the arcs that v's target had, and every state with
an arc u gains an arc w. After all merges a state is told by the last token read, and the accepted token sequences of a
word are exactly its one BPE segmentation.

`Automaton` compiles the gadgets into tables: for each token the state that its state was copied from (`base`), the symbol
beside which its arcs entered (`stem`) and the number of the gadget that made it (`born`), and all arcs that were cut. An
arc of any state is looked up by following these references; written out in full, 50,000 merges would make a table of 2.5
billion arcs. `Automaton.dense` does write it out, for small merge lists, and tests hold the two equal.

A word is encoded in one pass over its bytes without going back. A second table, a trie of the tokens with transitions to
the longest suffix, gives the tokens that end at a byte, longest first; exactly one of them is an arc of the state that was
reached where it begins, because each prefix has exactly one accepted sequence, and it is the state reached at this byte.
The tables are compiled once, on the driver, and broadcast. Decoding emits the label of each arc.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, documents, tidy

#: Fixed value: the pre-split pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of a generation: a worker remembers the last full one and the one under way, none longer than HELD_CHARS. Arcs and
#: transitions that it remembers before it starts anew.
HELD_WORDS, HELD_CHARS, HELD_ARCS = 100_000, 48, 300_000


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: a byte that prints stands for itself, the others follow from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def _unsupported(said: dict) -> list[str]:
    """Settings of a tokenizer file that would change its tokens and that this module does not implement."""
    model, before = said["model"], said.get("pre_tokenizer") or {}
    found = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    found += ["model.type"] if model.get("type", "BPE") != "BPE" else []
    found += ["normalizer"] if said.get("normalizer") else []
    found += ["pre_tokenizer"] if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) else []
    found += ["decoder"] if (said.get("decoder") or {}).get("type") != "ByteLevel" else []
    return found + [f"added_tokens.{k}" for k in ("single_word", "lstrip", "rstrip") if any(x.get(k) for x in said["added_tokens"])]


class Automaton:
    """labels: bytes of each id; merges: (u, v, w) by rank; special: ids of texts that are cut out before anything else."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int] | None = None):
        self.labels, self.special = labels, special or {}
        self.base, self.stem, self.born = list(range(len(labels))), list(range(len(labels))), [-1] * len(labels)
        self.cut: dict[int, int] = {}
        made = {w for _, _, w in merges}
        live = {k for k, x in enumerate(labels) if len(x) == 1 and k not in made}
        for i, (u, v, w) in enumerate(merges):
            self.base[w], self.stem[w], self.born[w] = v, u, i
            if u in live and v in live and self._has(u, v, i):
                live.add(w)
            self.cut.setdefault((u << 20) | v, i)
        self.ids = {labels[k]: k for k in sorted(live)}
        self._trie()
        self._ready()

    def _trie(self) -> None:
        """edges: node * 256 + byte -> node; fail: the node of a node's longest proper suffix; ends: the longest token that a
        node ends with, -1 if none; shorter: the next shorter one that a token ends with."""
        edges, fail, ends, queue = {}, [0], [-1], []
        for text, k in self.ids.items():
            node = 0
            for b in text:
                after = edges.get((node << 8) | b)
                if after is None:
                    after = edges[(node << 8) | b] = len(fail)
                    fail.append(0)
                    ends.append(-1)
                    queue.append((node, b))
                node = after
            ends[node] = k
        self.shorter = [-1] * len(self.labels)
        depth = [0] * len(fail)
        for at, (parent, b) in enumerate(queue, 1):
            depth[at] = depth[parent] + 1
        for at in sorted(range(1, len(fail)), key=depth.__getitem__):
            parent, b = queue[at - 1]
            if parent:
                up = fail[parent]
                while up and (up << 8) | b not in edges:
                    up = fail[up]
                fail[at] = edges.get((up << 8) | b, 0)
            if ends[at] >= 0:
                self.shorter[ends[at]] = ends[fail[at]]
            else:
                ends[at] = ends[fail[at]]
        self.edges, self.fail, self.ends = edges, fail, ends

    def _ready(self) -> None:
        self.good: set[int] = set()
        self.bad: set[int] = set()
        self.steps: dict[int, int] = {}
        self.sizes = [len(x) for x in self.labels]
        self.codes = [k.to_bytes(4, "little") for k in range(len(self.labels))]

    def packed(self) -> bytes:
        """The tables as bytes to be shipped."""
        numbers = [np.array(x, np.int32) for x in (self.base, self.stem, self.born, self.fail, self.ends, self.shorter)]
        pairs = [(np.array(list(x), np.int64), np.array(list(x.values()), np.int32)) for x in (self.cut, self.edges)]
        return zlib.compress(pickle.dumps((self.labels, self.special, self.ids, numbers, pairs), 5), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        made = cls.__new__(cls)
        made.labels, made.special, made.ids, numbers, pairs = pickle.loads(zlib.decompress(data))
        made.base, made.stem, made.born, made.fail, made.ends, made.shorter = (x.tolist() for x in numbers)
        made.cut, made.edges = (dict(zip(a.tolist(), b.tolist())) for a, b in pairs)
        made._ready()
        return made

    @classmethod
    def load(cls, path: str) -> Automaton:
        """A tokenizer file with a byte-level BPE model; ValueError if it has settings that aren't implemented."""
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        if wrong := _unsupported(said):
            raise ValueError(f"tokenizer settings that are not implemented: {', '.join(wrong)}")
        byte = byte_letters()
        vocab = said["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(x["id"] for x in said["added_tokens"])])
        labels = [b""] * size
        special = {x["content"]: x["id"] for x in said["added_tokens"]}
        for text, k in vocab.items():
            if text not in special:
                labels[k] = bytes(byte[c] for c in text)
        merges = []
        for pair in said["model"]["merges"]:
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        made = cls(labels, merges, special)
        if any(bytes([b]) not in made.ids for b in range(256)):
            raise ValueError("a byte has no token")
        for text, k in special.items():
            made.labels[k] = text.encode()
        return made

    @staticmethod
    def dense(n_bytes: int, merges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The whole automaton: arcs[p, t] and start[t] for symbols 0..n_bytes-1 and one new token per merge."""
        size = n_bytes + len(merges)
        arcs, start = np.zeros((size, size), bool), np.zeros(size, bool)
        arcs[:n_bytes, :n_bytes] = True
        start[:n_bytes] = True
        for i, (u, v) in enumerate(merges):
            w = n_bytes + i
            had_v = arcs[u, v]
            arcs[w, :w] = arcs[v, :w]
            arcs[u, v] = False
            if had_v:
                arcs[: w + 1, w] = arcs[: w + 1, u]
                start[w] = start[u]
        return arcs, start

    def _has(self, p: int, t: int, before: int) -> bool:
        """Arc t of p's state as it is before gadget number `before`."""
        cut, born = self.cut.get, self.born
        while True:
            if cut((p << 20) | t, before) < before:
                return False
            if born[t] < 0 and born[p] < 0:
                return True
            if born[t] >= born[p]:
                # t's arcs entered beside those of its stem, after the gadget had cut its own
                before, t = born[t] + 1, self.stem[t]
            else:
                # p's state is a copy of another, from before the gadget cut that one's arc
                before, p = born[p], self.base[p]

    def arc(self, p: int, t: int) -> bool:
        if len(self.good) + len(self.bad) > HELD_ARCS:
            self.good.clear()
            self.bad.clear()
        got = self._has(p, t, len(self.born))
        (self.good if got else self.bad).add((p << 20) | t)
        return got

    def step(self, node: int, b: int) -> int:
        """The node of the longest suffix that some token begins with, after one more byte."""
        if len(self.steps) > HELD_ARCS:
            self.steps.clear()
        at = node
        while (got := self.edges.get((at << 8) | b)) is None and at:
            at = self.fail[at]
        got = self.steps[(node << 8) | b] = got or 0
        return got

    def word(self, text: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        if text in self.ids:
            return [self.ids[text]]
        steps, good, bad, ends, shorter, sizes = self.steps, self.good, self.bad, self.ends, self.shorter, self.sizes
        states, node, at = [-1], 0, 0
        for b in text:
            at += 1
            try:
                node = steps[(node << 8) | b]
            except KeyError:
                node = self.step(node, b)
            t = ends[node]
            while True:
                if t < 0:
                    raise ValueError("a byte has no token")
                # the state where the token begins; before the first byte every token fits
                p = states[at - sizes[t]]
                if p < 0 or (pair := (p << 20) | t) in good or pair not in bad and self.arc(p, t):
                    break
                t = shorter[t]
            states.append(t)
        path = []
        while at:
            path.append(t := states[at])
            at -= sizes[t]
        path.reverse()
        return path


class Encoder:
    """Texts to little-endian 32-bit ids and back."""

    def __init__(self, automaton: Automaton, pattern: str = PATTERN):
        codes, word_of = automaton.codes.__getitem__, automaton.word

        class Words(dict):
            old: dict[str, bytes] = {}

            def __missing__(self, word):
                got = self.old.get(word)
                if got is None:
                    got = b"".join(map(codes, word_of(word.encode())))
                if len(word) <= HELD_CHARS:
                    self[word] = got
                return got

        self.automaton, self.words = automaton, Words()
        self.split = regex.compile(pattern).findall
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(automaton.special, key=len, reverse=True))) if automaton.special else None

    def encode(self, text: str) -> bytes:
        if len(self.words) > HELD_WORDS:
            self.words.old = dict(self.words)
            self.words.clear()
        if self.special is None or not self.special.search(text):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += map(self.words.__getitem__, self.split(text[at : m.start()]))
            out.append(self.automaton.codes[self.automaton.special[m[0]]])
            at = m.end()
        out += map(self.words.__getitem__, self.split(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(Automaton.load(path))


@functools.cache
def _tables(path: str) -> bytes:
    return Automaton.load(path).packed()


def _udf(spark: SparkSession, path: str, batch, kind: str):
    """An Arrow UDF that puts each array through batch(encoder, array). The tables are compiled here and broadcast packed; a
    task unpacks them, and what it has remembered goes with it: the worker that stays has the memory for other operators."""
    shipped = spark.sparkContext.broadcast(_tables(path))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(Automaton.unpacked(shipped.value))
        try:
            for x in arrays:
                yield batch(enc, x)
                tidy()
        finally:
            del enc
            gc.collect()
            tidy()

    # the annotations are read when the UDF is made
    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def encode_udf(spark: SparkSession, path: str):
    """text -> ids, binary of little-endian 32-bit integers; null text is empty."""
    return _udf(spark, path, lambda enc, text: pa.array([enc.encode(x.as_py() or "") for x in text], pa.binary()), "binary")


def decode_udf(spark: SparkSession, path: str):
    """ids -> text; bytes that are no UTF-8 are replaced."""
    return _udf(spark, path, lambda enc, ids: pa.array([enc.decode(x.as_py() or b"").decode("utf-8", "replace") for x in ids], pa.string()), "string")


def round_trip_udf(spark: SparkSession, path: str):
    """text -> n_tokens, digests of ids and of the decoded text, one pass."""

    def batch(enc: Encoder, text: pa.Array) -> pa.Array:
        n, a, b = [], [], []
        for x in text:
            ids = enc.encode(x.as_py() or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(enc.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return _udf(spark, path, batch, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with `token_ids` (array<int>), `n_tokens` and `round_trip`: whether decoding gives the text back.

    Null text counts as empty and has no tokens; other columns stay, repeated rows too. Columns of the three names are
    replaced. An empty table gives an empty result.
    """

    def batch(enc: Encoder, text: pa.Array) -> pa.Array:
        ids, same = [], []
        for x in text:
            said = x.as_py() or ""
            got = enc.encode(said)
            ids.append(np.frombuffer(got, "<i4"))
            same.append(enc.decode(got) == said.encode())
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["ids", "same"])

    spark = docs.sparkSession
    bounded_batches(spark)
    got = docs.withColumn("__bpe", _udf(spark, path, batch, "ids array<int>, same boolean")(F.col(text_col)))
    got = got.withColumn("token_ids", F.col("__bpe.ids")).withColumn("round_trip", F.col("__bpe.same")).drop("__bpe")
    return got.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", round_trip_udf(spark, vocabulary())(F.col("text")).alias("r")).select("doc_id", "r.*")
