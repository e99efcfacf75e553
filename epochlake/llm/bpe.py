"""Byte-level BPE: encode whole texts by a pair occurrence index, decode ids back to text."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: The published pattern that splits text before merges, and an upper bound of ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 30
STRIDE = 1024
#: Rows encoded together, new words merged together, and parts of texts that a worker remembers.
ROWS = 2048
MERGED_WORDS = 150_000
KEPT_PARTS = 600_000


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load_vocabulary(path: str) -> dict:
    """Arrays of a byte-level BPE file: merges by rank, bytes of each id, special strings."""
    with open(path, "rb") as f:
        raw = f.read()
    spec = json.loads(raw)
    if spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
    ids, alphabet = spec["model"]["vocab"], byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*ids.values(), *special.values()]) + 1
    spelled: list[bytes] = [b""] * size
    for token, i in ids.items():
        spelled[i] = bytes(alphabet[c] for c in token)
    for token, i in special.items():
        spelled[i] = token.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
    made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
    keys = (left << 20) | right
    order = np.argsort(keys, kind="stable")
    byte_id = np.zeros(256, dtype=np.int64)
    for c, b in alphabet.items():
        byte_id[b] = ids[c]
    return {"name": hashlib.sha256(raw).hexdigest(), "keys": keys[order], "ranks": order.astype(np.int64), "left": left, "right": right, "made": made, "byte_id": byte_id, "spelled": spelled, "special": special}


class PairIndexEncoder:
    """Encodes many words at once.

    Each adjacent pair of symbols of the batch is listed under its merge rank. Ranks are applied in ascending
    order, each to all its positions together, and only the pairs next to a merge get new list entries. A merge
    makes pairs of later ranks only, so one ascending pass is complete. Entries of far ranks wait in one log
    and are dealt to lists a stride of ranks at a time.
    """

    def __init__(self, vocabulary: dict):
        self.__dict__.update(vocabulary)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and word numbers (ascending) of all words after every merge."""
        n = len(symbols)
        sym = symbols.astype(np.int32)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[np.flatnonzero(np.diff(word, append=-1))] = -1
        prv[np.flatnonzero(np.diff(word, prepend=-1))] = -1
        rank_at = np.full(n, NEVER, dtype=np.int32)
        has = np.flatnonzero(nxt >= 0).astype(np.int32)
        rank_at[has] = self.rank(sym[has], sym[has + 1])
        log = [np.flatnonzero(rank_at < NEVER).astype(np.int32)]
        alive = np.ones(n, dtype=bool)
        for low in range(0, len(self.left), STRIDE):
            waiting = np.concatenate(log) if len(log) > 1 else log[0]
            ranks = rank_at[waiting]
            waiting, ranks = waiting[ranks < NEVER], ranks[ranks < NEVER]
            now = ranks < low + STRIDE
            log = [waiting[~now]]
            lists: dict[int, list[np.ndarray]] = {}
            heap: list[int] = []
            self._deal(waiting[now], ranks[now], lists, heap)
            while heap:
                r = heapq.heappop(heap)
                got = lists.pop(r)
                at = np.unique(np.concatenate(got) if len(got) > 1 else got[0])
                at = at[rank_at[at] == r]
                if not len(at):
                    continue
                if self.left[r] == self.right[r] and len(at) > 1:  # overlapping pairs: every other one of a chain
                    start = np.ones(len(at), dtype=bool)
                    start[1:] = nxt[at[:-1]] != at[1:]
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
                gone = nxt[at]
                after = nxt[gone]
                sym[at] = self.made[r]
                alive[gone] = False
                rank_at[gone] = NEVER
                nxt[at] = after
                has = after >= 0
                prv[after[has]] = at[has]
                before = prv[at]
                touched = np.unique(np.concatenate((at, before[before >= 0])))
                follows = nxt[touched]
                fresh = np.full(len(touched), NEVER, dtype=np.int32)
                ok = follows >= 0
                fresh[ok] = self.rank(sym[touched[ok]], sym[follows[ok]])
                rank_at[touched] = fresh
                soon = fresh < low + STRIDE
                if soon.any():
                    self._deal(touched[soon], fresh[soon], lists, heap)
                later = touched[(fresh < NEVER) & ~soon]
                if len(later):
                    log.append(later)
        return sym[alive], word[alive]

    @staticmethod
    def _deal(places: np.ndarray, ranks: np.ndarray, lists: dict[int, list[np.ndarray]], heap: list[int]) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else [], np.split(places, cuts), strict=False):
            if r in lists:
                lists[r].append(part)
            else:
                lists[r] = [part]
                heapq.heappush(heap, r)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ranges laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Spans:
    """Ids of numbered strings, laid end to end."""

    def __init__(self):
        self.number = Numbering()
        self.clear()

    def clear(self) -> None:
        self.number.clear()
        self.starts = self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def fresh(self) -> list[str]:
        """Strings that have a number but no ids yet."""
        return list(itertools.islice(self.number, len(self.starts), None))

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids[ragged(self.starts[numbers], self.lengths[numbers])]


class Codec:
    """Encode and decode with one vocabulary; one instance serves a task.

    A text is cut before each single space between two visible characters, where a word always ends. The parts
    (words with what clings to them) are numbered; parts not seen before in this task are split by the pattern,
    and the new words among them go through the pair index together.
    """

    def __init__(self, vocabulary: dict):
        import regex

        self.encoder = PairIndexEncoder(vocabulary)
        self.split = regex.compile(PATTERN).findall
        self.loose = regex.compile(r" \s|\s | \Z").search
        self.special = vocabulary["special"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lengths = np.array([len(x) for x in vocabulary["spelled"]], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(vocabulary["spelled"]), dtype=np.uint8)
        self.words, self.parts = Spans(), Spans()

    def pieces(self, text: str) -> list[str]:
        """Parts of a text in order; special strings stand alone."""
        if self.cut is not None and any(s in text for s in self.special):
            return [p for k, part in enumerate(self.cut.split(text)) for p in ([part] if k % 2 else self.pieces(part))]
        if self.loose(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + p for p in rest]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; new parts are learnt together until there are very many."""
        group: list[np.ndarray] = []
        for text in texts:
            pieces = self.pieces(text)
            group.append(np.fromiter(map(self.parts.number.__getitem__, pieces), dtype=np.int32, count=len(pieces)))
            if len(self.parts.number) >= KEPT_PARTS:
                yield from self._ids(group)
                group = []
        yield from self._ids(group)

    def _ids(self, group: list[np.ndarray]) -> Iterator[np.ndarray]:
        self._learn()
        for numbers in group:
            yield self.parts.of(numbers)
        if len(self.parts.number) >= KEPT_PARTS:
            self.parts.clear()
            self.words.clear()

    def _learn(self) -> None:
        new = self.parts.fresh()
        if not new:
            return
        inside = [[p] if p in self.special else self.split(p) for p in new]
        counts = np.array([len(x) for x in inside], dtype=np.int64)
        numbers = np.fromiter((self.words.number[w] for x in inside for w in x), dtype=np.int64, count=int(counts.sum()))
        fresh = self.words.fresh()
        for k in range(0, len(fresh), MERGED_WORDS):
            self.words.add(*self._merged(fresh[k : k + MERGED_WORDS]))
        total = np.concatenate(([0], np.cumsum(self.words.lengths[numbers])))
        ends = np.cumsum(counts)
        self.parts.add(self.words.of(numbers), total[ends] - total[ends - counts])

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, laid end to end, and their number for each word."""
        raw = [b"" if w in self.special else w.encode("utf-8", "surrogatepass") for w in words]
        symbols, owner = self.encoder.merge(self.encoder.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.repeat(np.arange(len(raw)), [len(x) for x in raw]))
        lengths = np.bincount(owner, minlength=len(raw)).astype(np.int64)
        for k, w in enumerate(words):
            if w in self.special:
                symbols, lengths[k] = np.insert(symbols, int(lengths[:k].sum()), self.special[w]), 1
        return symbols, lengths

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return self.spelled[ragged(self.starts[ids], self.lengths[ids])].tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec_of(name: str, vocabulary: Broadcast) -> Codec:
    """One codec for all tasks that a Python worker runs with this vocabulary."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(vocabulary.value)
    return _codecs[name]


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode `text` of every row and decode the ids again.

    Adds ids (array<int>) and decoded (string) as far as keep names them, and n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit integers) and decoded_sha256 (UTF-8). Null and empty texts have no ids. Strings of special tokens in a
    text become their ids. Long texts are encoded whole. Other columns, and repeated rows, pass through as they
    are; columns named like those added are replaced. Nothing is shuffled; the vocabulary that is broadcast is
    bounded by its file.
    """
    loaded = load_vocabulary(vocabulary_path)
    name, vocabulary = loaded["name"], docs.sparkSession.sparkContext.broadcast(loaded)
    added = {k: kind for k, kind in (("ids", "array<int>"), ("decoded", "string")) if k in keep}
    added |= {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    base = docs.drop(*(c for c in docs.columns if c.lower() in added and c != text))
    names = [c for c in base.columns if c.lower() not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(name, vocabulary)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts = [(t or b"").decode("utf-8", "replace") for t in texts_of(batch, text)]
            ids, back, n, h, g = [], [], [], [], []
            for x in codec.encode(texts):
                y = codec.decode(x)
                n.append(len(x))
                h.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                g.append(hashlib.sha256(y.encode("utf-8", "surrogatepass")).hexdigest())
                if "ids" in keep:
                    ids.append(x)
                if "decoded" in keep:
                    back.append(y)
            made = [pa.array(x, kind) for k, x, kind in (("ids", ids, pa.list_(pa.int32())), ("decoded", back, pa.string())) if k in keep]
            made += [pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(g, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in names), *(f"{k} {v}" for k, v in added.items())])
    return base.mapInArrow(run, schema)


def digest(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode(docs.select("doc_id", "text"), vocabulary_path, keep=())
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
