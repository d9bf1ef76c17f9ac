"""LM scoring by a weighted backoff automaton.

The model counts words (and one end per text) over all training documents and smooths them by absolute discounting. Its
states are all training words and the root. An arc leads from a state along every bigram seen in training, with its
smoothed weight; every state has a failure arc to the root that pays the state's backoff weight; at the root each known
word has an arc and unknown words share one. A text is scored by one traversal from the start state (a text's start is
an end), which carries the state and adds up log10 weights. All probabilities of a state sum to one.

Counts are gathered without a row per word of the corpus: a task reads its documents in chunks, numbers the words of a
chunk, and sends each distinct word once per chunk, packed by key range ("shard"). A shard adds up the chunks' counts,
numbers the training words and answers every chunk in the order asked. The chunks are kept as numbers, so texts are read
once; their distinct bigrams are sent to shards in the same way, as pairs of word numbers. Every token of a text is
followed by one, so a word is left as often as it is counted, and its failure arc needs only the number of its distinct
bigrams: the shards of bigrams send these to the shards of words, which answer the chunks. No table of words or states is
held in one place: chunks and shards are bounded, and a word in every document reaches a shard once per chunk.

Defined results: a null text is empty and scores its end. Texts with a null id are training texts. Without training
tokens every text scores 0. An empty table gives no rows; repeated rows count and score each. Only the id (an integer)
and text columns are looked at. Words are told apart by 64-bit hashes, bigrams by both words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ownerscope.llm.common import materialize, mix64, slices
from ownerscope.llm.shingles import words_of

STATE_SHARE = math.inf  # a state needs one training token in this many: every training word is one
DISCOUNT = 0.75
CHUNK_BYTES = 12 << 20
SHARD_KEYS = 400_000
END_KEY = xxhash.xxh3_64_intdigest(b"end", seed=1)
SLICE = 400_000


def held_out(doc) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def _pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _unpack(packed: bytes, dtype: type) -> np.ndarray:
    if not packed:
        return np.zeros(0, dtype)
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: its documents, their tokens as numbers, the numbers' keys and training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        ids, names, sizes, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, names, sizes, size, made
            tokens = np.concatenate(ids)
            train = np.repeat([not held_out(d) for d in names], sizes)
            digest = xxhash.xxh3_64_intdigest
            keys = np.fromiter((digest(w) for w in number), np.uint64, len(number))
            keys = np.append(np.array([END_KEY], np.uint64), keys)
            counts = np.bincount(tokens[train], minlength=len(keys))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part * (1 << 24) + made], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                 *(pa.array([_pack(x)], pa.binary()) for x in (np.array(sizes, np.int32), tokens.astype(np.int32), keys, counts.astype(np.int32))),
                 pa.array([int(counts.sum())], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([len(tokens)], pa.int64())],
                names=["chunk", "docs", "sizes", "tokens", "keys", "counts", "n_train", "n_keys", "n_tokens"])
            number, ids, names, sizes, size, made = {}, [], [], [], 0, made + 1
            return row

        for batch in slices(batches, "text", 1 << 20):
            for d, t in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(t)
                own = list(map(number.get, words))
                if None in own:
                    for k, v in enumerate(own):
                        if v is None:
                            own[k] = number.setdefault(words[k], len(number) + 1)
                own.append(0)
                ids.append(np.array(own, np.int32))
                names.append(d)
                sizes.append(len(own))
                size += len(t or "")
                if size >= CHUNK_BYTES:
                    yield flush()
        if names:
            yield flush()

    return docs.mapInArrow(run, "chunk long, docs array<long>, sizes binary, tokens binary, keys binary, counts binary, "
                           "n_train long, n_keys long, n_tokens long")


def _shards(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a chunk's keys by shard, and the ends of the shards in it. A key is a row of one or two numbers."""
    code = keys[:, 0] if keys.shape[1] == 1 else mix64(keys[:, 0] + mix64(keys[:, 1]))
    shard = (code % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _asked(chunk: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """A chunk's keys and counts by shard; within a shard in the chunk's order."""
    order, ends = _shards(keys, shards)
    counts, rows = counts.astype(np.int32), []
    for s in range(shards):
        if ends[s] < ends[s + 1]:
            own = order[ends[s]:ends[s + 1]]
            first = np.diff(keys[own, 0], prepend=np.uint64(0))  # small where keys are sorted
            rows.append((s, chunk, _pack(np.concatenate([first, *keys[own, 1:].T])), _pack(counts[own])))
    return _rows(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["shard", "chunk", "keys", "counts"])


def _answered(keys: np.ndarray, answers, shards: int, what: str = "totals") -> np.ndarray:
    """The shards' answers in the order of a chunk's keys."""
    order, _ = _shards(keys, shards)
    out = np.zeros(len(keys), np.int64)
    parts = sorted(answers or [], key=lambda x: x["shard"])
    if parts:
        out[order] = np.concatenate([_unpack(x[what], np.int64) for x in parts])
    return out


ASKED = "shard int, chunk long, keys binary, counts binary"
NOBODY = -1  # in place of a chunk, where no answer is wanted


def _rows(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, their totals, and the place of every key among them."""
    order = np.lexsort(keys.T)
    own = keys[order]
    new = np.append(True, (own[1:] != own[:-1]).any(axis=1))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return own[new], np.bincount(place, counts).astype(np.int64), place


def totals(asked: DataFrame, width: int, shards: int) -> DataFrame:
    """Each chunk's totals per shard (kind 0). With keys of one number also the places of the keys among the counted ones of
    the shard, and per shard its numbers of keys that are counted, counted once and counted twice (kind 1); with keys of two,
    the distinct counted keys of each first number, as counts for the shards of words (kind 2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "shard", "chunk", "totals", "places"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        now = None

        def resolve() -> pa.RecordBatch:
            keys, total, place = _totals(np.concatenate([k for _, k, _ in held]), np.concatenate([c for _, _, c in held]))
            reply, number, rows, at = total[place], (np.cumsum(total > 0) - 1)[place], [], 0
            for chunk, k, _ in held:
                if chunk != NOBODY:
                    rows.append((0, now, chunk, _pack(reply[at:at + len(k)]), _pack(number[at:at + len(k)]) if width == 1 else None))
                at += len(k)
            if width == 1:
                rows.append((1, now, None, _pack(np.array([(total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64)), None))
                return _rows(rows, types, names)
            states, distinct = np.unique(keys[total > 0, 0], return_counts=True)
            sent = _asked(NOBODY, states.reshape(-1, 1), distinct, shards)
            rows += [(2, r["shard"], NOBODY, r["keys"], r["counts"]) for r in sent.to_pylist()]
            return _rows(rows, types, names)

        for batch in batches:
            for k in range(batch.num_rows):
                s, chunk, keys, counts = (batch.column(c)[k].as_py() for c in ("shard", "chunk", "keys", "counts"))
                if s != now and held:
                    yield resolve()
                    held = []
                now = s
                got = _unpack(keys, np.uint64).reshape(width, -1).T
                got = np.column_stack([np.cumsum(got[:, 0], dtype=np.uint64), *got[:, 1:].T])
                held.append((chunk, got, _unpack(counts, np.int32)))
        if held:
            yield resolve()

    return materialize(asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        run, "kind int, shard int, chunk long, totals binary, places binary"))


def _by_chunk(answers: DataFrame, name: str, *what: str) -> DataFrame:
    return answers.where("kind = 0").groupBy("chunk").agg(F.collect_list(F.struct("shard", *what)).alias(name))


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of chunks with their packed columns as arrays; the keys and numbers of words one below the other."""
    types = {"sizes": np.int32, "tokens": np.int32, "keys": np.uint64, "counts": np.int32, "words": np.uint64, "known": np.int64}
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            row.update({c: _unpack(row[c], t) for c, t in types.items() if c in row})
            row.update({c: row[c].reshape(-1, 1) for c in ("keys", "words") if c in row})
            yield row


def numbered(read: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """Each chunk with its training words in the order of their numbers, their counts, and its tokens as places among them;
    all other words are one, behind the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            keys, answers = row["keys"], row["answers"]
            counts = _answered(keys, answers, shards)
            number = _answered(keys, answers, shards, "places") * shards + (keys[:, 0] % np.uint64(shards)).astype(np.int64)
            known = np.flatnonzero(counts > 0)
            known = known[np.argsort(number[known])]
            label = np.full(len(keys), len(known), np.int32)
            label[known] = np.arange(len(known))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]], pa.int64()), pa.array([row["docs"]], pa.list_(pa.int64())),
                 *(pa.array([_pack(x)], pa.binary()) for x in (row["sizes"], label[row["tokens"]], number[known].astype(np.uint64), counts[known]))],
                names=["chunk", "docs", "sizes", "tokens", "words", "known"])

    return materialize(read.select("chunk", "docs", "sizes", "tokens", "keys").join(_by_chunk(words, "answers", "totals", "places"), "chunk").mapInArrow(
        run, "chunk long, docs array<long>, sizes binary, tokens binary, words binary, known binary"))


def _bigrams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The word before each token of a chunk (a text starts in the end's state, as the text before it left it), the tokens
    where both are training words, the distinct bigrams there by both numbers, and which of these each is."""
    tokens, n = row["tokens"], len(row["words"])
    before = np.concatenate([tokens[-1:], tokens[:-1]])
    place = np.flatnonzero((before < n) & (tokens < n))
    distinct, inverse = np.unique(before[place].astype(np.int64) * n + tokens[place], return_inverse=True)
    return before, place, np.concatenate([row["words"][distinct // max(n, 1)], row["words"][distinct % max(n, 1)]], axis=1), inverse


@dataclass
class Model:
    """What all texts share."""

    n: int                 # training tokens
    v: int                 # distinct training tokens
    discount: float        # of single words

    def root(self, counts: np.ndarray) -> np.ndarray:
        """Weights of the root's arcs."""
        if not self.n:
            return np.ones(len(counts))
        return np.where(counts > 0, (counts - self.discount) / self.n, self.discount * self.v / self.n)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def traverse(self, root: np.ndarray, own: np.ndarray, distinct: np.ndarray, arc: np.ndarray) -> np.ndarray:
        """log10 weight of each token: its arc from the word before, with what that state's failure arc adds. ``own`` and
        ``distinct`` are the counts of the word before and of the bigrams it begins; without any it is the root."""
        fail = np.where(own > 0, DISCOUNT * distinct / np.maximum(own, 1), 1.0)
        direct = np.where(arc > 0, (arc - DISCOUNT) / np.maximum(own, 1), 0.0)
        return np.log10(direct + fail * root)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    read = materialize(chunks(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))))
    sums = read.agg(F.sum("n_train").alias("n"), F.sum("n_keys").alias("keys"), F.sum("n_tokens").alias("tokens")).first()
    n, shards, pair_shards = int(sums["n"] or 0), *(max(1, math.ceil((sums[c] or 0) / SHARD_KEYS)) for c in ("keys", "tokens"))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            yield _asked(row["chunk"], row["keys"], row["counts"], shards)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            _, place, keys, inverse = _bigrams(row)
            train = np.repeat([not held_out(d) for d in row["docs"]], row["sizes"])[place]
            yield _asked(row["chunk"], keys, np.bincount(inverse, train, len(keys)), pair_shards)

    def ask_distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            yield _asked(row["chunk"], row["words"], np.zeros(len(row["words"])), shards)

    words = totals(read.select("chunk", "keys", "counts").mapInArrow(ask_words, ASKED), 1, shards)
    facts = np.zeros(3, np.int64)
    for r in words.where("kind = 1").select("totals").toLocalIterator():  # one row of three numbers per shard
        facts += _unpack(r["totals"], np.int64)
    v, n1, n2 = (int(x) for x in facts)
    model = Model(n, v, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
    known = numbered(read, words, shards)
    pairs = totals(known.select("chunk", "docs", "sizes", "tokens", "words").mapInArrow(ask_pairs, ASKED), 2, shards)
    begun = pairs.where("kind = 2").select("shard", "chunk", F.col("totals").alias("keys"), F.col("places").alias("counts"))
    distinct = totals(known.select("chunk", "words").mapInArrow(ask_distinct, ASKED).unionByName(begun), 1, shards)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            tokens, sizes, docs_of = row["tokens"], row["sizes"], row["docs"]
            before, place, keys, inverse = _bigrams(row)
            arcs = np.zeros(len(tokens), np.int64)
            arcs[place] = _answered(keys, row["pairs"], pair_shards)[inverse]
            counts, begins = np.append(row["known"], 0), np.append(_answered(row["words"], row["distinct"], shards), 0)
            root, base = model.root(counts), model.base(counts)
            total, plain, hits = (np.zeros(len(sizes)) for _ in range(3))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            for at in range(0, len(tokens), SLICE):
                t, b, own = (x[at:at + SLICE] for x in (tokens, before, owner))
                total += np.bincount(own, model.traverse(root[t], counts[b], begins[b], arcs[at:at + SLICE]), len(sizes))
                plain += np.bincount(own, base[t], len(sizes))
                hits += np.bincount(own, counts[t] > 0, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_of, pa.int64()), pa.array([held_out(d) for d in docs_of]), pa.array(sizes.astype(np.int64)),
                 pa.array(hits.astype(np.int64)), pa.array(np.full(len(sizes), model.n)), pa.array(plain), pa.array(total)],
                names=["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = known
    for answers, name in ((pairs, "pairs"), (distinct, "distinct")):
        both = both.join(_by_chunk(answers, name, "totals"), "chunk", "left")
    return both.mapInArrow(finish, "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
                           ).withColumnRenamed("doc", id_col)
