"""SentencePiece encoding and decoding by a streaming Viterbi.

The shipped public model is a BPE model: its ids follow from merges by score, not from the best sum of scores. A sequence
of pieces is that model's encoding when every two neighbours stay two pieces if merged alone, and each prefix of a text
has exactly one such sequence. So the lattice's paths are compared by that rule: ``last[i]`` is the piece that ends the
encoding of the first i symbols, found among the pieces that end there and fit the piece before. Only the last
``longest`` positions can be extended; once the paths back from all of them meet at one boundary, the ids before it are
final and leave the window. Memory is bounded by the longest piece and by how long paths stay apart.

Pieces never continue into a new word mark, so texts are encoded word by word and workers keep the words they have seen.
Symbols outside the vocabulary become their UTF-8 bytes' pieces.

Defined results: null is an empty text and has no ids; decoding gives back every text, with the word mark U+2581 as a
space. An empty table gives no rows; repeated rows give equal rows. Only the id and text columns are looked at.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ownerscope.llm.common import slices

MARK = "▁"
REMEMBERED = 500_000
TAIL = ".,;:!?*&%$#|"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A SentencePiece BPE model's pieces and the encoder over them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.vocab_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.text = {i: m.id_to_piece(i) for i in plain}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: m.get_score(i) for t, i in self.id.items()}
        self.byte = {int(m.id_to_piece(i)[3:-1], 16): i for i in range(size) if m.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.id))
        self.fit: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.raw = [m.id_to_piece(i).encode() if i in self.text else bytes([self.of_byte[i]]) if i in self.of_byte else b"" for i in range(size)]
        #: ends of pieces; those that are pieces note which pieces may stand before them
        self.ending: dict[str, dict[str, bool] | None] = {t[k:]: None for t in self.id for k in range(len(t))}
        self.ending.update((t, {}) for t in self.id)
        self.noted = 0
        self.word = {t: array("I", [i]).tobytes() for t, i in self.id.items()}
        #: the lattice of the text encoded last: the piece that ends each prefix
        self.text_before, self.last = "", [""]
        #: neighbours inside some piece: nothing merges over a boundary between others
        self.joined = {pair for t in self.id for pair in zip(t, t[1:])}
        ascii_ = "".join(map(chr, range(32, 127)))
        self.plain = m.normalize(ascii_) == MARK + ascii_.replace(" ", MARK)  # whether plain text is left as it is

    def stay(self, left: str, right: str) -> bool:
        """Whether merging the symbols of two pieces by score, the leftmost first among equals, gives the two pieces."""
        if left and left + right in self.score:
            return False  # these two would merge
        symbols, edge, score = [*left, *right], len(left), self.score.get
        while len(symbols) > 1:
            best, at, before = None, 0, symbols[0]
            for k in range(1, len(symbols)):
                after = symbols[k]
                found = score(before + after)
                if found is not None and (best is None or found > best):
                    best, at = found, k
                before = after
            if best is None:
                break
            if at == edge:
                return False  # merged over the edge
            if at < edge:
                edge -= 1
            symbols[at - 1:at + 1] = [symbols[at - 1] + symbols[at]]
        return symbols == [p for p in (left, right) if p]

    def fits(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay as they are."""
        pair = (left, right)
        got = self.fit.get(pair)
        if got is None:
            if len(self.fit) > REMEMBERED:
                self.fit.clear()
            got = self.fit[pair] = self.stay(left, right)
        return got

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of symbols, given out as soon as they are final."""
        last: dict[int, str] = {0: ""}  # end of a piece -> the piece that ends there, for the open window
        window, base, n = "", 0, 0      # symbols after ``base``, the last final boundary
        ids, score, longest, fits = self.id, self.score, self.longest, self.fits
        for symbol in symbols:
            window += symbol
            n += 1
            if symbol not in score:  # stands alone: bytes, and nothing merges over it
                last[n] = symbol
            else:
                for size in range(min(longest, n - base), 0, -1):
                    piece = window[-size:]
                    if piece in score and (before := last.get(n - size)) is not None and fits(before if before in score else "", piece):
                        last[n] = piece
                        break
            if n - base > 4 * longest:
                live = [k for k in last if k > n - longest]
                while len(live) > 1 and max(live) > base:
                    k = max(live)
                    live.remove(k)
                    back = k - len(last[k])
                    if back not in live:
                        live.append(back)
                boundary = live[0]
                if boundary > base:
                    yield from self._back(last, base, boundary)
                    window = window[boundary - base:]
                    last = {k: v for k, v in last.items() if k >= boundary}
                    base = boundary
        yield from self._back(last, base, n)

    def within(self, text: str) -> bytes:
        """Ids of a text that fits the window: the same lattice without boundaries to commit.

        A prefix has one encoding only, so the pieces that end it may be tried from the shortest on, until none ends like that,
        and the prefix that a text shares with the one before needs no new search: sorted texts share most of theirs.
        """
        last, at = self.last, 0
        for a, b in zip(text, self.text_before):
            if a != b:
                break
            at += 1
        del last[at + 1:]
        find, add = self.ending.get, last.append
        for n in range(at + 1, len(text) + 1):
            start = n - 1
            piece = text[start]
            known = find(piece)
            if known is None:  # stands alone
                add(piece)
                continue
            while known is not False:
                if known is not None and (before := last[start]) is not None:
                    good = known.get(before)
                    if self.neighbours(before, piece) if good is None else good:
                        add(piece)
                        break
                if not start:
                    break
                start -= 1
                piece = text[start:n]
                known = find(piece, False)
            if len(last) == n:  # no piece ends here
                add(None)
        self.text_before = text
        found, end, words = [], len(text), self.word
        while end:
            piece = last[end]
            ids = words.get(piece)
            found.append(self.alone(piece) if ids is None else ids)
            end -= len(piece)
        found.reverse()
        return b"".join(found)

    def alone(self, symbol: str) -> bytes:
        """Ids of a symbol outside the vocabulary, remembered like a piece's."""
        ids = self.word[symbol] = array("I", [self.byte[b] for b in symbol.encode("utf-8", "surrogatepass")]).tobytes()
        return ids

    def neighbours(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay as they are, noted at the right one."""
        self.noted += 1
        if self.noted > REMEMBERED:
            self.noted = 1
            for known in self.ending.values():
                if known:
                    known.clear()
        got = self.ending[right][left] = self.stay(left if left in self.score else "", right)
        return got

    def _back(self, last: dict[int, str], base: int, end: int) -> list[int]:
        pieces = []
        while end > base:
            pieces.append(last[end])
            end -= len(last[end])
        out = []
        for p in reversed(pieces):
            out += [self.id[p]] if p in self.id else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def words(self, text: str) -> list[str]:
        """A text's stretches over whose boundaries no piece goes."""
        if self.plain and text.isascii() and text.isprintable() and text.strip(" ") == text and "  " not in text:
            return [MARK + w for w in text.split(" ")]
        normal = self.model.normalize(text)
        if MARK + MARK in normal:
            return _WORDS.findall(normal)
        first, *rest = normal.split(MARK)
        return [*([first] if first else []), *[MARK + w for w in rest]]

    def of_word(self, word: str) -> bytes:
        """Ids of a word: of its stem and of the punctuation after it, if no piece has both."""
        at = len(word.rstrip(TAIL))
        if not 0 < at < len(word) or (word[at - 1], word[at]) in self.joined:
            return self.of_stem(word)
        return self.of_stem(word[:at]) + self.of_stem(word[at:])

    def of_stem(self, part: str) -> bytes:
        ids = self.stems.get(part)
        if ids is None:
            ids = self.within(part) if len(part) <= 4 * self.longest else array("I", self.stream(part)).tobytes()
            if len(part) <= self.longest:
                self.stems[part] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a batch of texts as 32-bit words; each distinct word is looked up once."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.stems) > REMEMBERED:
            self.stems = {}
        split = [self.words(t) if t else [] for t in texts]
        known = self.known
        fresh = set().union(*split) - known.keys()
        for w in sorted(fresh):
            known[w] = self.of_word(w)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > 64:  # long words are not kept beyond their batch
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that make no character are replaced."""
        numbers = array("I")
        numbers.frombytes(ids)
        whole = b"".join(map(self.raw.__getitem__, numbers)).decode("utf-8", "replace").replace(MARK, " ")
        return whole[1:] if whole.startswith(" ") else whole


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One model per Python worker and path."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ids as little-endian 32-bit words."""
    path = path or default_path()
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches, "text", 1 << 20):
            got = model.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(got, pa.binary())], names=["doc", "ids"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc {id_type}, ids binary").withColumnRenamed("doc", id_col)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, n_ids, ids_crc32 and the decoded text."""
    path = path or default_path()
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches, "ids", 1 << 20):
            ids = [x or b"" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                 pa.array([model.decode(x) for x in ids], pa.string())], names=["doc", "n_ids", "ids_crc32", "text"])

    return encoded.select(F.col(id_col).alias("doc"), "ids").mapInArrow(
        run, f"doc {id_type}, n_ids long, ids_crc32 long, text string").withColumnRenamed("doc", id_col)
