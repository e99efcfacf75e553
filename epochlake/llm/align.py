"""Alignment of two tokenizers' ids over the same bytes, and how often their ids end together in a corpus.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model with byte fallback. Both read a space
before the text (B adds its own). Byte offsets at which tokens of both end cut their ids into groups.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Numbering, byte_alphabet, ragged
from .common import texts_of

#: Rows and characters taken together, characters of new chunks encoded together, and chunks and their characters kept.
ROWS, CHARACTERS = 1024, 4_000_000
LEARNT_CHARACTERS = 20_000
KEPT_CHUNKS, KEPT_CHARACTERS = 600_000, 12_000_000

#: What a text may be cut into without a change of either side's tokens: see Aligner.
CHUNK = re.compile(r" .*?(?:\S(?= )|\Z)", re.DOTALL)
LOOSE = re.compile(r"\s ").search
MARK = "▁"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def token_bytes(a_file: bytes, b_file: bytes) -> tuple[list[bytes], list[bytes]]:
    """The bytes that each id of A and of B stands for; control and unknown pieces stand for none."""
    import sentencepiece

    spec, alphabet = json.loads(a_file), byte_alphabet()
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    special = {t["id"] for t in spec.get("added_tokens", [])}
    a = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        a[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
    model = sentencepiece.SentencePieceProcessor(model_proto=b_file)
    b = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(MARK, " ").encode())
    return a, b


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs (A id << 32 | B id) that can end together, ascending.

    Tokens that end at one offset of one text are suffixes of each other, so an id has no more partners than bytes and
    partners of equal bytes: a few hundred thousand pairs by the two vocabularies alone, whatever the corpus.
    """
    by_a: dict[bytes, list[int]] = {}
    by_b: dict[bytes, list[int]] = {}
    for spelled, by in ((a, by_a), (b, by_b)):
        for i, x in enumerate(spelled):
            if x:
                by.setdefault(x, []).append(i)
    found = {(i << 32) | j for i, x in enumerate(a) for k in range(len(x)) for j in by_b.get(x[k:], ())}
    found |= {(i << 32) | j for j, x in enumerate(b) for k in range(len(x)) for i in by_a.get(x[k:], ())}
    return np.array(sorted(found), dtype=np.int64)


class Aligner:
    """Aligns texts with one pair of tokenizers; serves the tasks of a Python worker.

    A text, with its space in front, is cut into chunks before each space that follows a visible character. There A's
    pattern always begins a new word, for nothing in it goes from a visible character to white space, and no piece of B
    holds a space after another character, so both sides encode each chunk as they encode it within the text. New
    chunks are encoded together and aligned once; a text's results are put together from those of its chunks.
    """

    def __init__(self, a_file: bytes, b_file: bytes, pairs: np.ndarray):
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(a_file.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        before = json.loads(a_file)
        split, has = before["pre_tokenizer"], before.get("normalizer")
        if has or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        self.a_bytes, self.b_bytes = token_bytes(a_file, b_file)
        self.a_size, self.b_size = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes))
        self.apart = split.get("use_regex", True) and not any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        self.pairs, self.counts = pairs, None
        # ids as they are written in groups: A's before a comma and before the bar, B's before a comma and at a group's end
        self.written = [f"{i}{end}" for size, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(size)]
        self.number = Numbering()
        self.clear()

    def count(self, name: object, counts: np.ndarray) -> None:
        """Take over the corpus's links by possible pair; sums of the chunks that are known follow."""
        if self.counts is not None and self.counts[0] == name:
            return
        best = np.zeros(len(self.b_bytes), dtype=np.int64)
        np.maximum.at(best, self.pairs & 0xFFFFFFFF, counts)
        self.counts = name, np.stack([(counts > 0) & (counts == best[self.pairs & 0xFFFFFFFF]), counts], axis=1).astype(np.int64)
        self.numbers[:, 4:] = self.summed(self.links, self.numbers[:, 3])

    def summed(self, links: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best links and counts of chunks that have so many links each."""
        if self.counts is None:
            return np.zeros((len(sizes), 2), dtype=np.int64)
        running = np.concatenate((np.zeros((1, 2), dtype=np.int64), np.cumsum(self.counts[1][links], axis=0)))
        ends = np.cumsum(sizes)
        return running[ends] - running[ends - sizes]

    def clear(self) -> None:
        self.number.clear()
        self.characters = 0
        self.seen = np.zeros(0, dtype=np.int64)  # times that each chunk was met
        self.numbers = np.zeros((0, len(NUMBERS)), dtype=np.int64)  # a row for each chunk
        self.valid: list[bool] = []
        self.groups: list[str] = []
        self.links = np.zeros(0, dtype=np.int32)  # of all chunks, end to end, as numbers of possible pairs

    def chunks(self, text: str) -> list[str]:
        spaced = " " + text
        if not self.apart:
            return [spaced]
        return CHUNK.findall(spaced) if LOOSE(spaced) else [" " + x for x in text.split(" ")]

    def align(self, text: str, bound: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Ids of both sides and the indices of the tokens that end together; None if bytes differ or if a chunk's end,
        of which bound has the offsets, isn't among them."""
        a = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
        b = np.array(self.pieces.encode(text[1:], num_threads=1), dtype=np.int64)
        raw = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            return None
        a_index = dict(zip(np.cumsum(self.a_size[a]).tolist(), range(len(a)), strict=True))
        b_index = dict(zip(np.cumsum(self.b_size[b]).tolist(), range(len(b)), strict=True))
        common = a_index.keys() & b_index.keys()
        if not common.issuperset(bound.tolist()):
            return None
        ends = sorted(common)
        of_a, of_b = (np.fromiter(map(x.__getitem__, ends), dtype=np.int64, count=len(ends)) for x in (a_index, b_index))
        return a, b, of_a, of_b, np.array(ends, dtype=np.int64)

    def learn(self) -> None:
        """Align the chunks that have a number but no results yet."""
        new = list(self.number)[len(self.valid) :]
        found, linked, at = [], [], 0
        while at < len(new):
            size, end = 0, at
            # a chunk that ends in white space would run into the next one's space; marks that stand for spaces don't come back
            while end < len(new) and size < LEARNT_CHARACTERS and self.apart and not new[end][-1].isspace() and MARK not in new[end]:
                size, end = size + len(new[end]), end + 1
            rows, links = self.add(new[at : max(end, at + 1)])
            found, linked = found + rows, linked + links
            at = max(end, at + 1)
        self.numbers, self.links = np.concatenate([self.numbers, *found]), np.concatenate([self.links, *linked])

    def add(self, chunks: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Align some chunks together, or in halves where that can't be: their numbers and their links."""
        bound = np.cumsum([len(c.encode()) for c in chunks])
        found = self.align("".join(chunks), bound)
        if found is None and len(chunks) > 1:
            both = self.add(chunks[: len(chunks) // 2]), self.add(chunks[len(chunks) // 2 :])
            return both[0][0] + both[1][0], both[0][1] + both[1][1]
        self.characters += sum(map(len, chunks))
        self.valid += [found is not None] * len(chunks)
        if found is None:
            self.groups.append("")
            return [np.zeros((1, len(NUMBERS)), dtype=np.int64)], []
        a, b, of_a, of_b, ends = found
        last = np.searchsorted(ends, bound)  # the group that ends each chunk
        sizes = [np.diff(x, prepend=0) for x in (of_a[last] + 1, of_b[last] + 1, last + 1)]
        links = np.searchsorted(self.pairs, (a[of_a] << 32) | b[of_b]).astype(np.int32)
        # a group's ids of A, then those of B
        sizes_a, sizes_b = np.diff(of_a, prepend=-1), np.diff(of_b, prepend=-1)
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(of_b + 1 - sizes_b, sizes_a)] = a
        order[np.arange(len(b)) + np.repeat(of_a + 1, sizes_b)] = b + 2 * len(self.a_bytes)
        order[of_a + of_b + 1 - sizes_b] += len(self.a_bytes)
        order[of_a + of_b + 1] += len(self.b_bytes)
        said, first = list(map(self.written.__getitem__, order.tolist())), 0
        for end in (of_a[last] + of_b[last] + 2).tolist():
            self.groups.append("".join(said[first:end]))
            first = end
        return [np.concatenate((np.stack([*sizes, sizes[2]], axis=1), self.summed(links, sizes[2])), axis=1)], [links]

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of the chunks of each text; none where the text has no tokens."""
        found = []
        for text in texts:
            chunks = self.chunks(text) if text else []
            found.append(np.fromiter(map(self.number.__getitem__, chunks), dtype=np.int64, count=len(chunks)))
        self.learn()
        valid = np.array(self.valid, dtype=bool)
        for k, x in enumerate(found):
            if not valid[x].all():  # what a chunk loses can't be told from what its neighbours gain: judge the whole text
                whole = self.number[" " + texts[k]]
                self.learn()
                found[k] = np.array([whole] if self.valid[whole] else [], dtype=np.int64)
        times = np.bincount(np.concatenate([*found, np.zeros(0, dtype=np.int64)]), minlength=len(self.valid))
        times[: len(self.seen)] += self.seen
        self.seen = times
        return found

    def rest(self) -> None:
        """Once much was learnt, forget all but the chunks that came back; all of them if those are many, too."""
        if len(self.number) <= KEPT_CHUNKS and self.characters <= KEPT_CHARACTERS:
            return
        stay = np.flatnonzero(self.seen > 2)
        words, sizes = list(self.number), self.numbers[:, 3]
        words = [words[k] for k in stay.tolist()]
        if len(stay) > KEPT_CHUNKS // 2 or sum(map(len, words)) > KEPT_CHARACTERS // 2:
            self.clear()
            return
        self.number.clear()
        self.number.update(zip(words, range(len(words)), strict=True))
        self.characters = sum(map(len, words))
        self.links = self.links[ragged((np.cumsum(sizes) - sizes)[stay], sizes[stay])]
        self.numbers, self.seen = self.numbers[stay], np.zeros(len(stay), dtype=np.int64)
        self.valid, self.groups = ([x[k] for k in stay.tolist()] for x in (self.valid, self.groups))


def portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows and their texts, of bounded size together but for single texts."""
    for batch in batches:
        texts, first, size = [], 0, 0
        for k, raw in enumerate(texts_of(batch, column)):
            if texts and (len(texts) == ROWS or size + len(raw or b"") > CHARACTERS):
                yield batch.slice(first, len(texts)), texts
                texts, first, size = [], k, 0
            texts.append(None if raw is None else raw.decode("utf-8", "replace"))
            size += len(raw or b"")
        if texts:
            yield batch.slice(first, len(texts)), texts


_aligners: dict[str, Aligner] = {}


def aligner_of(name: str, files) -> Aligner:
    """One aligner for all tasks, of both passes, that a Python worker runs with these files."""
    if name not in _aligners:
        _aligners.clear()
        _aligners[name] = Aligner(*files.value)
    return _aligners[name]


def shared_files(docs: DataFrame, a_path: str, b_path: str):
    """Both files and the possible pairs, sent to the workers once: bounded by the files."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = a.read(), b.read()
    pairs = possible_pairs(*token_bytes(*files))
    name = hashlib.sha256(files[0] + files[1]).hexdigest()
    return name, docs.sparkSession.sparkContext.broadcast((*files, pairs)), pairs


def counted(docs: DataFrame, text: str, name: str, files) -> DataFrame:
    """Links of the corpus by possible pair: rows (pair, n), n summed over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(name, files)
        total = np.zeros(len(aligner.pairs), dtype=np.int64)
        for _, texts in portions(batches, text):
            numbers = aligner.texts(texts)
            times = np.bincount(np.concatenate([*numbers, np.zeros(0, dtype=np.int64)]), minlength=len(aligner.valid))
            total += np.bincount(aligner.links, weights=np.repeat(times, aligner.numbers[:, 3]), minlength=len(total)).astype(np.int64)
            aligner.rest()
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["pair", "n"])

    return docs.select(text).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Pairs of ids that end together somewhere: (a, b, n links of the corpus, best: n is the highest of b's pairs)."""
    name, files, pairs = shared_files(docs, a_path, b_path)
    known = docs.sparkSession.createDataFrame(pa.table({"pair": np.arange(len(pairs)), "a": pairs >> 32, "b": pairs & 0xFFFFFFFF}).to_pandas())
    out = counted(docs, text, name, files).join(known, "pair")
    top = out.groupBy("b").agg(F.max("n").alias("top"))
    return out.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("groups",)) -> DataFrame:
    """Groups of ids of every row's text and what they count over the corpus.

    Adds groups (array of structs of two id lists a and b, if kept), n_a, n_b, n_groups, n_links (pairs of tokens that
    end at one byte), n_best (links whose pair is linked as often as any of its B id's), count_sum (of links of the
    corpus, over this text's links) and groups_sha256 (of the groups written as a1,a2|b1;a3|b2). Strings of special
    tokens are plain text. Null and empty texts, and texts that either side doesn't give back byte by byte, have no
    tokens: zeros and '' for the digest; they link nothing. Long texts count whole; rows that repeat count each; other
    columns pass through, those named like added ones are replaced.

    Two passes over the texts: one counts links by pair, summed before they are shuffled, the other sums up each text.
    What is collected and broadcast between them is a number for each pair that both vocabularies allow, a few hundred
    thousand at any size of corpus.
    """
    name, files, pairs = shared_files(docs, a_path, b_path)
    held = counted(docs, text, name, files).toArrow()
    counts = np.zeros(len(pairs), dtype=np.int64)
    counts[held.column("pair").to_numpy()] = held.column("n").to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(counts)
    digest = hashlib.sha256(counts.tobytes()).hexdigest()
    added = {"groups": "array<struct<a: array<int>, b: array<int>>>"} if "groups" in keep else {}
    added |= {**dict.fromkeys(NUMBERS, "long"), "groups_sha256": "string"}
    base = docs.drop(*(c for c in docs.columns if c.lower() in added and c != text))
    names = [c for c in base.columns if c.lower() not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(name, files)
        aligner.count(digest, known.value)
        for batch, texts in portions(batches, text):
            numbers = aligner.texts(texts)
            sums = aligner.numbers[np.concatenate([*numbers, np.zeros(0, dtype=np.int64)])]
            ends = np.cumsum([len(x) for x in numbers])
            running = np.concatenate((np.zeros((1, len(NUMBERS)), dtype=np.int64), np.cumsum(sums, axis=0)))
            of_text = running[ends] - running[ends - [len(x) for x in numbers]]
            written = ["".join(map(aligner.groups.__getitem__, x.tolist()))[:-1] for x in numbers]
            made = [pa.array(x) for x in of_text.T.copy()]
            made.append(pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in written], pa.string()))
            if "groups" in keep:
                lists = [[dict(zip("ab", ([int(i) for i in side.split(",")] for side in g.split("|")), strict=True)) for g in x.split(";")] if x else [] for x in written]
                made.insert(0, pa.array(lists, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *added])
            aligner.rest()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in names), *(f"{k} {v}" for k, v in added.items())])
    return base.mapInArrow(run, schema)


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, the counts of align and groups_sha256."""
    return align(docs.select("doc_id", "text"), a_path, b_path, keep=()).select("doc_id", *NUMBERS, "groups_sha256")
